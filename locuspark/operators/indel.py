"""Clusters of loci that differ by insertions and deletions.

Representatives are taken in order of length (longest first), then of id.  Each
joins a centroid that is near, or becomes one.  Near is: at least nine tenths as
long as the longer of the two, and identical to nine tenths, that is an edit
distance of at most a tenth of the longer.  Of several near centroids the one of
least edit distance is taken, then the first.

Pairs are found without loss.  A sequence of length l is cut into t + 1 pieces,
t being the most edits it may be away.  Of t edits, some piece i is spared such
that at most i are before it and at most t - i behind; so it stands in the other
sequence, moved by no more than i from the left end and t - i from the right.
Pieces are joined by equality, and the distance is worked out for pairs that meet.
A piece that very many sequences share is dealt in pairs of blocks.

The greedy choice is made in rounds over the near pairs: who has no earlier
neighbour left is a centroid, and its neighbours are members, whose own pairs
no longer count.  Nothing is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.operators.similarity import blocked, heavy_keys
from locuspark.plans.ordering import ranked
from locuspark.plans.scratch import materialize

SHORTEST = 32
_KEY = ["cut_length", "i", "piece"]


def representatives(popall: DataFrame, loci: DataFrame) -> DataFrame:
    """(poploc, seq): the allele with the least id of each locus; shorter ones than 32 are an error."""
    rank = F.row_number().over(W.partitionBy("poploc").orderBy("popall"))
    rows = popall.join(loci.select("poploc"), "poploc", "left_semi").withColumn("rank", rank).filter("rank = 1")
    seq = F.when(F.length("seq") >= SHORTEST, F.col("seq")).otherwise(F.raise_error(F.lit("a locus is shorter than 32")).cast("string"))
    return rows.select("poploc", seq.alias("seq"))


def _with_cuts(rows: DataFrame) -> DataFrame:
    """Rows once for each piece ``i`` of a sequence of ``cut_length`` letters, with its place ``at`` and length ``n`` and the most edits ``t``."""
    cut = lambda i: F.floor(i * F.col("cut_length") / (F.col("t") + 1)).cast("int")
    rows = rows.withColumn("t", F.floor(F.floor(10 * F.col("cut_length") / 9) / 10).cast("int"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t"))))
    return rows.withColumn("at", cut(F.col("i"))).withColumn("n", cut(F.col("i") + 1) - F.col("at"))


def _piece(start: Column) -> Column:
    return F.substr("seq", start + 1, F.col("n")).alias("piece")


def _cut(reps: DataFrame) -> DataFrame:
    """(cut_length, i, piece, id) of the pieces of each sequence."""
    return _with_cuts(reps.withColumn("cut_length", F.length("seq"))).select("cut_length", "i", _piece(F.col("at")), "id")


def _found(reps: DataFrame) -> DataFrame:
    """(cut_length, i, piece, id): what each sequence holds where a piece of one no longer than itself may be."""
    lengths = reps.select(F.length("seq").alias("cut_length")).distinct()
    rows = reps.withColumn("len", F.length("seq"))
    rows = rows.withColumn("cut_length", F.explode(F.sequence(F.ceil(9 * F.col("len") / 10).cast("int"), F.col("len"))))
    # Only lengths that occur are looked for; they are no more than the longest sequence has letters.
    rows = _with_cuts(rows.join(F.broadcast(lengths), "cut_length", "left_semi"))
    more = F.col("len") - F.col("cut_length")
    first = F.greatest(-F.col("i"), more - F.col("t") + F.col("i"), -F.col("at"))
    last = F.least(F.col("i"), more + F.col("t") - F.col("i"), F.col("len") - F.col("n") - F.col("at"))
    rows = rows.withColumn("shift", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.select("cut_length", "i", _piece(F.col("at") + F.col("shift")), "id").distinct()


def near_pairs(reps: DataFrame) -> DataFrame:
    """(a, b, len_a, dist) of all near pairs of (id, seq), a before b; len_a is the length of a."""
    reps = materialize(reps.filter("seq is not null"))
    have, want = materialize(_found(reps)), materialize(_cut(reps))
    heavy = heavy_keys(have, want, _KEY)
    left = blocked(have, heavy, _KEY, "l_blocks", "r_blocks", "id").withColumnRenamed("id", "a")
    right = blocked(want, heavy, _KEY, "r_blocks", "l_blocks", "id").select(*_KEY, F.col("id").alias("b"), F.col("block").alias("meets"), F.col("meets").alias("block"))
    met = left.join(right, [*_KEY, "block", "meets"]).select("a", "b").filter("a != b").distinct()
    one, two = (reps.select(F.col("id").alias(x), F.col("seq").alias(f"seq_{x}")) for x in "ab")
    met = met.join(one, "a").join(two, "b").filter("length(seq_a) > length(seq_b) or (length(seq_a) = length(seq_b) and a < b)")
    # Beyond the bound the distance is -1 and is not worked out to the end.
    return met.select("a", "b", F.length("seq_a").alias("len_a"), F.expr("levenshtein(seq_a, seq_b, cast(length(seq_a) div 10 as int))").alias("dist")).filter("dist >= 0")


def greedy(pairs: DataFrame) -> DataFrame:
    """(b, a): each member and its centroid, for the rows of ``near_pairs``."""
    pairs = materialize(pairs)
    left, members = pairs.select("a", "b"), None
    while not left.isEmpty():
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = materialize(left.join(first, "a", "left_semi").select("b").distinct())
        members = new if members is None else members.unionByName(new)
        rest = left.join(first, "a", "left_anti").join(new.withColumnRenamed("b", "a"), "a", "left_anti")
        left = materialize(rest.join(new, "b", "left_anti").select("a", "b"))
    if members is None:
        return pairs.select("b", "a")
    of_centroids = pairs.join(members.withColumnRenamed("b", "a"), "a", "left_anti")
    return of_centroids.groupBy("b").agg(F.min(F.struct("dist", -F.col("len_a"), "a")).getField("a").alias("a"))


def clusters(reps: DataFrame) -> DataFrame:
    """(poploc, cluster) of (poploc, seq): the locus that is the centroid.  A locus without a sequence is alone."""
    found = greedy(near_pairs(reps.select(F.col("poploc").alias("id"), "seq")))
    return reps.select("poploc").join(found.select(F.col("b").alias("poploc"), "a"), "poploc", "left").select("poploc", F.coalesce("a", "poploc").alias("cluster"))


def records(reps: DataFrame, found: DataFrame) -> DataFrame:
    """One ``line`` for each locus and cluster, as clustering tools write them: H a member, S a centroid, C a cluster."""
    rows = ranked(found.join(reps.select("poploc", F.length("seq").alias("sl")), "poploc"), ["cluster"], "no").withColumn("no", F.col("no") - 1)
    line = lambda kind, size, label, target: F.concat_ws("\t", F.lit(kind), "no", size, *[F.lit("*")] * 5, label, target).alias("line")
    own = F.concat(F.lit("L"), F.col("poploc").cast("string"))
    centroid = F.concat(F.lit("L"), F.col("cluster").cast("string"))
    each = rows.select(F.when(F.col("poploc") == F.col("cluster"), line("S", F.col("sl"), own, F.lit("*"))).otherwise(line("H", F.col("sl"), own, centroid)).alias("line"))
    size = rows.groupBy("no", "cluster").agg(F.count(F.lit(1)).alias("size"))
    return each.unionByName(size.select(line("C", F.col("size"), centroid, F.lit("*"))))


def outputs(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters numbered from 1, and loci that are alone in theirs."""
    n = F.count(F.lit(1)).over(W.partitionBy("cluster"))
    numbered = ranked(found.withColumn("n_loc", n), ["cluster"], "cluster_no").select("cluster_no", "poploc", "n_loc")
    return numbered, numbered.filter("n_loc = 1").select("poploc")
