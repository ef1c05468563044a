"""Loci, SNPs and alleles within individuals.

Relations carry ``ind``; there are no per-individual files and no per-
individual loops.  Sequence variants (svars) are distinct reads of an
individual with their depth.

Joins of tables that grow with the reads are merge joins by hint: the files of
such tables are so small for their rows that Spark would broadcast them, all
rows by way of the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.operators.components import connected_components
from locuspark.operators.similarity import similar_between, similar_pairs
from locuspark.plans.scratch import materialize


def svar_count(reads: DataFrame) -> DataFrame:
    """(ind, seq) to (ind, sl, seq, depth)."""
    return reads.groupBy("ind", "seq").agg(F.count(F.lit(1)).alias("depth")).select("ind", F.length("seq").alias("sl"), "seq", "depth")


def svar_count_rc(reads: DataFrame) -> DataFrame:
    """Like ``svar_count``, every read also counted as its reverse complement."""
    return svar_count(reads.select("ind", F.explode(F.array("seq", S.revcomp(F.col("seq")))).alias("seq")))


def dist_asof(lengths: DataFrame, config: list[tuple[int, int]], keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(keys, sl) with the distance that holds at each occurring length.

    Walking up the lengths that occur, the distance changes only at lengths
    that are configured; it starts with that of the smallest configured length.
    With ``strict``, configured lengths that do not occur count as well.
    """
    keys = keys or []
    first = dict(sorted(config))[min(c[0] for c in config)]
    if strict:
        steps = F.array(*[F.struct(F.lit(sl).alias("sl"), F.lit(d).alias("d")) for sl, d in sorted(config)])
        fit = F.filter(steps, lambda x: x["sl"] <= F.col("sl"))
        return lengths.select(*keys, "sl").distinct().withColumn("dist", F.coalesce(F.try_element_at(fit, F.lit(-1))["d"], F.lit(first)))
    own = F.coalesce(*[F.when(F.col("sl") == sl, F.lit(d)) for sl, d in config])
    up = W.partitionBy(*keys or [F.lit(1)]).orderBy("sl").rowsBetween(W.unboundedPreceding, 0)
    return lengths.select(*keys, "sl").distinct().withColumn("dist", F.coalesce(F.last(own, ignorenulls=True).over(up), F.lit(first)))


def locus_components(good: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ind, sl, seq, depth, first): first is the least sequence of the svar's component."""
    node = lambda c: F.concat_ws("|", "ind", c)
    found = connected_components(pairs.select(node("seq1").alias("a"), node("seq2").alias("b")))
    named = good.withColumn("node", node("seq")).join(found.hint("merge"), "node", "left")
    return named.select("ind", "sl", "seq", "depth", F.coalesce(F.element_at(F.split("component", r"\|"), -1), "seq").alias("first"))


def with_locus_ids(rows: DataFrame) -> DataFrame:
    """loc: rank of (sl, first) within the individual, from 1."""
    return rows.withColumn("loc", F.dense_rank().over(W.partitionBy("ind").orderBy("sl", "first")).cast("long"))


def rare_assign(rare: DataFrame, loci: DataFrame, d: Column | int) -> DataFrame:
    """Rare svars (ind, sl, seq, depth, loc) that are within d of exactly one locus."""
    near = similar_between(rare, loci, ["ind"], "seq", "seq", d, ignore_n=True, carry=["loc"])
    one = near.groupBy("ind", F.col("seq1").alias("seq")).agg(F.countDistinct("loc").alias("n"), F.min("loc").alias("loc")).filter("n = 1").drop("n")
    return rare.join(one.hint("merge"), ["ind", "seq"]).select("ind", "sl", "seq", "depth", "loc")


def loci_of(svars: DataFrame, good_depth: int, hapdist: Column | int, raredist: Column | int) -> DataFrame:
    """Svars of loci: (ind, loc, sl, seq, depth, good)."""
    good, rare = svars.filter(F.col("depth") >= good_depth), svars.filter(F.col("depth") < good_depth)
    loci = materialize(with_locus_ids(locus_components(good, similar_pairs(good, ["ind"], "seq", hapdist, ignore_n=True))))
    both = loci.select("ind", "loc", "sl", "seq", "depth", F.lit(True).alias("good"))
    return both.unionByName(rare_assign(rare, loci, raredist).select("ind", "loc", "sl", "seq", "depth", F.lit(False).alias("good")))


def locus_depth(used: DataFrame) -> DataFrame:
    return used.groupBy("ind", "loc", "sl").agg(F.sum("depth").alias("loc_dep"))


def _variable(used: DataFrame) -> DataFrame:
    """(ind, loc, sl, loc_dep, word, pos): positions (from 1; null where there is none) at which the svars of a locus differ.

    Codes are summed up by ``bit_or`` and ``bit_and``, so no svar is spelled out and nothing is gathered.
    """
    words = used.select("ind", "loc", "sl", "depth", F.posexplode(S.codes(F.col("seq"))).alias("word", "code"))
    differ = F.bit_or("code").bitwiseXOR(F.bit_and("code"))
    sums = words.groupBy("ind", "loc", "sl", "word").agg(F.sum("depth").alias("loc_dep"), differ.alias("bits"))
    # Three bits a letter; the lowest one tells whether any of them differs.
    sums = sums.withColumn("bits", F.col("bits").bitwiseOR(F.shiftrightunsigned("bits", 1)).bitwiseOR(F.shiftrightunsigned("bits", 2)).bitwiseAND(F.lit((8**S.CODED - 1) // 7)))
    length = F.least(F.lit(S.CODED), F.col("sl") - F.col("word") * S.CODED)
    places = F.when(F.col("bits") == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), length), lambda p: F.getbit("bits", 3 * (length - p)) == 1))
    return sums.select("ind", "loc", "sl", "loc_dep", "word", F.explode_outer(F.transform(places, lambda p: p + F.col("word") * S.CODED)).alias("pos"))


def _replaced(sums: DataFrame, least_of) -> DataFrame:
    """(ind, loc, pos, olds, new): the letters to be replaced at a position, and what stands for them.

    ``sums`` has the depth of each letter at the positions that vary; ``least_of``
    gives the least depth of a good base.  Bad letters, N among them, become the
    good base if there is just one, else N.
    """
    joined = lambda letters, cond: F.concat(*[F.when(cond(x), x).otherwise("") for x in letters])
    rows = sums.withColumn("least", least_of({x: F.col(x) for x in "ACGT"}, F.col("loc_dep")))
    rows = rows.withColumn("good", joined("ACGT", lambda x: (F.col(x) > 0) & (F.col(x) >= F.col("least"))))
    rows = rows.withColumn("bad", joined("ACGTN", lambda x: (F.col(x) > 0) & ~F.col("good").contains(x)))
    one = F.length("good") == 1
    rows = rows.select("ind", "loc", "pos", F.when(one, F.col("bad")).otherwise(F.translate("bad", "N", "")).alias("olds"), F.when(one, F.col("good")).otherwise("N").alias("new"))
    return rows.filter("olds != ''")


def _corrected(used: DataFrame, least_of) -> DataFrame:
    """Svars with their corrected sequence: depths by position and letter, then a join of what they replace.

    Only positions that vary are spelled out.  A locus gets at most one
    replacement a position, so its row stays small however many svars it has.
    """
    variable = materialize(_variable(used))
    at = variable.filter("pos is not null").select("ind", "loc", "loc_dep", "pos")
    letters = used.select("ind", "loc", "seq", "depth").join(at.hint("merge"), ["ind", "loc"]).withColumn("letter", F.expr("substr(seq, pos, 1)"))
    sums = letters.groupBy("ind", "loc", "loc_dep", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("letter") == x, F.col("depth"))), F.lit(0)).alias(x) for x in "ACGTN"])
    swaps = _replaced(sums, least_of).groupBy("ind", "loc").agg(F.collect_list(F.struct("pos", "olds", "new")).alias("swaps"))
    loci = variable.filter("word = 0").select("ind", "loc", "loc_dep").distinct().join(swaps.hint("merge"), ["ind", "loc"], "left")
    new = F.aggregate("swaps", F.col("seq"), lambda s, w: F.when(F.contains(w["olds"], F.substr("seq", w["pos"], F.lit(1))), F.overlay(s, w["new"], w["pos"])).otherwise(s))
    return used.join(loci.hint("merge"), ["ind", "loc"]).select("ind", "loc", "sl", "loc_dep", "seq", "depth", F.when(F.col("swaps").isNull(), F.col("seq")).otherwise(new).alias("corrected"))


def snp_call_freq(used: DataFrame, c: float = 0.2) -> DataFrame:
    """Svars with their corrected sequence, by least frequency c of a base (-1: none)."""
    if c == -1:
        return used.withColumn("loc_dep", F.sum("depth").over(W.partitionBy("ind", "loc"))).select("ind", "loc", "sl", "loc_dep", "seq", "depth", F.col("seq").alias("corrected"))
    return _corrected(used, lambda col, dep: F.floor(dep * F.lit(float(c))))


def binom_least(n1: Column, n2: Column, e: float) -> Column:
    """Least depth of a good base beside bases of depths n1 >= n2."""
    if not 0 <= e < 0.5:
        raise ValueError("the error rate must be from 0 to below 0.5")
    if e == 0:
        return F.lit(0)
    least = F.floor(n1 * F.lit(math.log((1 - e) / 0.5)) / F.lit(math.log(0.5 / e)) + 1)
    return F.greatest(least, n2)


def snp_call_binom(used: DataFrame, e: float = 0.01) -> DataFrame:
    """Svars with their corrected sequence, by likelihood ratio at error rate e."""

    def least(col: Column, dep: Column) -> Column:
        depths = F.sort_array(F.array(*[col[x] for x in "ACGT"]), asc=False)
        one = depths[1] == 0
        return F.when(one, 0).otherwise(binom_least(depths[0], depths[1], e))

    return _corrected(used, least)


def _compatible(seqs: DataFrame) -> DataFrame:
    """Edges (a, b), both ways, between sequences of a locus that agree but for N; ends are ``ind|loc|seq``."""
    pairs = similar_pairs(seqs, ["ind", "loc"], "seq", 0, ignore_n=True)
    ends = [F.concat_ws("|", "ind", "loc", c) for c in ("seq1", "seq2")]
    return pairs.select(F.explode(F.array(F.struct(ends[0].alias("a"), ends[1].alias("b")), F.struct(ends[1].alias("a"), ends[0].alias("b")))).alias("e")).select("e.a", "e.b")


def _consensus(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq): the base found at each position, N if there is none; members agree but for N.

    Codes (N is 4) are summed up: ``bit_and`` has a 4 where all have N, the lower bits of ``bit_or`` have the base.
    """
    of = lambda digit: F.lit(digit * ((8**S.CODED - 1) // 7))
    words = members.select(*keys, F.length("seq").alias("_n"), F.posexplode(S.codes(F.col("seq"))).alias("_word", "_code"))
    code = F.bit_or("_code").bitwiseAND(of(3)).bitwiseOR(F.bit_and("_code").bitwiseAND(of(4)))
    each = words.groupBy(*keys, "_n", "_word").agg(code.alias("_code"))
    n = F.least(F.lit(S.CODED), F.col("_n") - F.col("_word") * S.CODED)
    part = F.translate(F.lpad(F.conv(F.col("_code").cast("string"), 10, 8), n, F.lit("0")), "01234", "ACGTN")
    each = each.select(*keys, F.struct("_word", part.alias("part")).alias("_part"))
    return each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["part"]), "").alias("seq"))


def groups_of(corrected: DataFrame, binom: bool = False) -> DataFrame:
    """(ind, loc, sl, loc_dep, seq, depth, lost, more): groups of compatible corrected svars.

    Sequences of a locus that agree but for N are linked.  A component whose
    members are all linked to each other (the sum of degrees tells) is a group.
    From any other one the members with N are taken out; the rest form groups,
    and a member taken out gives its depth to those it agrees with: in
    proportion to theirs, or, with ``binom``, all of it if there is but one.
    ``lost`` alleles and whether there may be ``more`` are the locus's; a locus
    without a group has one row with a null sequence.

    Equal sequences are summed first (``k`` svars).  Loci without N are told apart at
    once, as each of their sequences is a group; the graph and all joins hold the
    others only.  The graph is a table of links; donation is a join of it.
    """
    keys = ["ind", "loc", "sl", "loc_dep"]
    seqs = corrected.groupBy(*keys, F.col("corrected").alias("seq")).agg(F.sum("depth").cast("double").alias("depth"), F.count(F.lit(1)).alias("k"))
    every = materialize(seqs)
    with_n = every.filter(F.col("seq").contains("N")).select("ind", "loc").distinct().hint("merge")
    seqs = materialize(every.join(with_n, ["ind", "loc"], "left_semi").withColumn("node", F.concat_ws("|", "ind", "loc", "seq")))
    alone = every.join(with_n, ["ind", "loc"], "left_anti").select(*keys, "seq", "depth", F.lit(0).alias("lost"), F.lit(0).alias("more"))
    links = materialize(_compatible(seqs))
    parts = connected_components(links)
    degree = links.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    placed = materialize(seqs.join(parts.join(degree.hint("merge"), "node").hint("merge"), "node", "left").withColumn("out", F.col("seq").contains("N")))
    members = placed.filter("component is not null")
    plain = placed.filter("component is null").select(*keys, "seq", "depth")

    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("k"))), F.lit(0))
    size = F.count(F.lit(1))
    shape = members.groupBy("component").agg((F.sum("degree") == size * (size - 1)).alias("clique"), count(F.col("out")).alias("n_out"), count(~F.col("out")).alias("n_stay"))
    members = materialize(members.join(shape.hint("merge"), "component"))
    cliques = members.filter("clique")
    whole = _consensus(cliques, [*keys, "component"]).join(cliques.groupBy("component").agg(F.sum("depth").alias("depth")).hint("merge"), "component").select(*keys, "seq", "depth")

    mixed = members.filter("not clique")
    side = lambda e: mixed.select(F.col("node").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in ("out", "depth", "k")])
    pairs = materialize(links.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").filter("a_out"))
    to_stay = pairs.filter("not b_out").groupBy(F.col("a").alias("node")).agg(F.sum("b_depth").alias("stay_depth"), F.sum("b_k").alias("stay_k"))
    roles = materialize(mixed.join(to_stay.hint("merge"), "node", "left").withColumn("role", F.when(~F.col("out"), "stay").when(F.col("stay_k").isNotNull(), "donor").otherwise("other")))
    others = roles.filter("role = 'other'").select(F.col("node").alias("b"))
    beside = pairs.join(others.hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("b_depth").alias("beside_depth"), F.sum("b_k").alias("beside_k"))
    donors = roles.filter("role = 'donor'").join(beside.hint("merge"), "node", "left").select(F.col("node").alias("a"), (F.col("stay_depth") + F.coalesce("beside_depth", F.lit(0.0))).alias("whole"), (F.col("stay_k") + F.coalesce("beside_k", F.lit(0))).alias("n_whole"))
    gift = F.when(F.col("n_whole") == 1, F.col("a_depth")).otherwise(0.0) if binom else F.col("a_depth") * F.col("b_depth") / F.col("whole")
    given = pairs.filter("not b_out").join(donors.hint("merge"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(gift).alias("given"))
    stay = roles.filter("role = 'stay'").join(given.hint("merge"), "node", "left").select(*keys, "seq", (F.col("depth") + F.coalesce("given", F.lit(0.0))).alias("depth"))

    per = roles.groupBy(*keys, "component", "n_out", "n_stay").agg(F.count_if(F.col("role") == "other").alias("others"), F.count_if(F.col("role") == "donor").alias("donors"))
    lost = F.when(F.col("n_stay") == 0, 2).when((F.col("n_stay") == 1) | (F.col("others") > 0), 1).otherwise(0)
    more = F.when(F.col("n_stay") == 0, F.col("n_out") > 2).when((F.col("n_stay") == 1) | (F.col("others") > 0), F.col("n_out") > 1).otherwise(F.col("donors") > 0)
    losses = per.groupBy(*keys).agg(F.sum(lost).cast("int").alias("lost"), F.max(more.cast("int")).alias("more"))
    groups = materialize(plain.unionByName(whole).unionByName(stay))
    bare = losses.join(groups.select("ind", "loc").hint("merge"), ["ind", "loc"], "left_anti").select(*keys, F.lit(None).cast("string").alias("seq"), F.lit(None).cast("double").alias("depth"), "lost", "more")
    found = groups.join(losses.select("ind", "loc", "lost", "more").hint("merge"), ["ind", "loc"], "left").select(*keys, "seq", "depth", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("more", F.lit(0)).alias("more"))
    return found.unionByName(bare).unionByName(alone)


def alleles(groups: DataFrame, least_freq: float = 0.2, binom: bool = False, min_depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Loci (ind, loc, cat, sl, loc_dep, n_alleles, lost_alleles, potlostmore) and alleles of groups.

    freq: groups below int(least_freq * depth of the locus) are lost, and those
    with N.  binom: those with N, and of more than two what is rarer than the
    second.
    """
    g = groups.withColumn("ok", F.col("seq").isNotNull() & ~F.col("seq").contains("N") & (F.col("loc_dep") >= min_depth))
    if binom:
        second = F.nth_value("depth", 2).over(W.partitionBy("ind", "loc", "ok").orderBy(F.desc("depth"), "seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        g = g.withColumn("ok", F.col("ok") & (F.col("depth") >= F.coalesce(second, F.lit(0.0))))
    else:
        g = g.withColumn("ok", F.col("ok") & (F.col("depth") >= F.floor(F.col("loc_dep") * F.lit(float(least_freq)))))
    shallow = F.max("loc_dep") < min_depth
    loci = g.groupBy("ind", "loc", "sl", "loc_dep").agg(F.count_if("ok").alias("n_alleles"), F.when(shallow, 1).otherwise(F.max("lost") + F.count_if(~F.col("ok") & F.col("seq").isNotNull())).cast("long").alias("lost_alleles"), F.when(shallow, 1).otherwise(F.max("more")).alias("potlostmore"))
    loci = loci.select("ind", "loc", F.when(F.col("n_alleles") > 0, "valid").otherwise("lost").alias("cat"), "sl", "loc_dep", "n_alleles", "lost_alleles", "potlostmore")
    kept = g.filter("ok").withColumn("all_id", F.row_number().over(W.partitionBy("ind", "loc").orderBy("seq")))
    return loci, kept.select("ind", "loc", "sl", "all_id", "seq", "depth")


def reads_annotate(reads: DataFrame, svars: DataFrame, both_strands: bool = False) -> DataFrame:
    """Reads with the columns of their svar (ind, seq); others vanish.

    With ``both_strands`` a read also stands for its reverse complement, as which
    it may have an svar of its own.  The join is on the strand that comes first in
    order, so it is as one join for either; ``strand`` tells f or r, ``seq`` is the
    svar's, and ``mate`` the number the read's name gets: 1, or 2 for r.  A read
    that equals its reverse complement comes as both.
    """
    if not both_strands:
        return reads.join(svars, ["ind", "seq"])
    first = lambda s: F.least(s, S.revcomp(s))
    left = reads.withColumn("read_seq", F.col("seq")).withColumn("first", first(F.col("seq"))).drop("seq")
    both = left.join(svars.withColumn("first", first(F.col("seq"))), ["ind", "first"]).drop("first")
    f, r = F.col("seq") == F.col("read_seq"), F.col("seq") == S.revcomp(F.col("read_seq"))
    strands = F.array_compact(F.array(F.when(f, F.lit("f")), F.when(r, F.lit("r"))))
    return both.withColumn("strand", F.explode(strands)).withColumn("mate", F.when(F.col("strand") == "f", 1).otherwise(2)).drop("read_seq")


def mate_header(header: Column, mate: Column) -> Column:
    """A read's name with the number of the mate at its end in place of 1."""
    return F.when(mate == 1, header).otherwise(F.regexp_replace(header, "_1$", "_2"))
