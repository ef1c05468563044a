"""Tables and recodings of selected genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.plans.ordering import ranked, running_sum

MISSING = "-999"


def genotype_cells(links: DataFrame, gt: DataFrame) -> DataFrame:
    """(poploc, ind, alleles, depths): popallvars sorted and joined by ``/``, depths in that order.

    An allele found in two loci of an individual counts once, with the larger depth.
    """
    rows = links.join(gt, ["poploc", "ind"], "left_semi").groupBy("poploc", "ind", "popallvar").agg(F.max("depth").alias("depth"))
    per = rows.groupBy("poploc", "ind").agg(F.array_sort(F.collect_list(F.struct("popallvar", "depth"))).alias("a"))
    shown = F.array_join(F.transform("a", lambda x: x["depth"].cast("long").cast("string")), "/")
    return per.select("poploc", "ind", F.array_join(F.transform("a", lambda x: x["popallvar"]), "/").alias("alleles"), shown.alias("depths"))


def dense(items: Column, at: Column, fill, n: Column) -> Column:
    """``items`` (arrays of values, in order) at their places (arrays of numbers from 1) among n, with fillers between.

    ``fill(k)`` is an array of k fillers.  The work is in proportion to the result.
    """
    gap = lambda p, i: p - F.when(i > 0, F.get(at, i - 1)).otherwise(0) - 1
    parts = F.flatten(F.transform(F.arrays_zip(at.alias("p"), items.alias("v")), lambda x, i: F.concat(fill(gap(x["p"], i)), F.array(x["v"]))))
    return F.concat(parts, fill(n - F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0))))


def individual_index(inds: DataFrame) -> DataFrame:
    """(ind, place): the place, from 1, of each individual among all."""
    return ranked(inds.select("ind").distinct(), ["ind"], "place")


def matrix_rows(cells: DataFrame, value: str, index: DataFrame, block: int = 1000, missing: str = MISSING) -> DataFrame:
    """(poploc, block, first, cells): the cells of a locus in arrays of up to ``block`` individuals, by their place.

    ``first`` is the place of the array's first cell.  Arrays stay small however
    many individuals there are, and nothing depends on their names.
    """
    n = index.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    blocks = F.sequence(F.lit(0), F.lit(max(0, -(-n // block) - 1)))
    size = F.least(F.lit(block), F.lit(n) - F.col("block") * block)
    own = cells.join(index, "ind").select("poploc", F.floor((F.col("place") - 1) / block).cast("int").alias("block"), ((F.col("place") - 1) % block + 1).cast("int").alias("at"), F.col(value).alias("value"))
    held = own.groupBy("poploc", "block").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("c")).select("poploc", "block", "c.at", "c.value")
    rows = cells.select("poploc").distinct().select("poploc", F.explode(blocks).alias("block")).join(held, ["poploc", "block"], "left")
    at, values = F.coalesce("at", F.array().cast("array<int>")), F.coalesce("value", F.array().cast("array<string>"))
    rows = rows.select("poploc", "block", size.cast("int").alias("size"), at.alias("at"), values.alias("value"))
    return rows.select("poploc", "block", (F.col("block") * block + 1).alias("first"), dense(F.col("value"), F.col("at"), lambda k: F.array_repeat(F.lit(missing), k), F.col("size")).alias("cells"))


def matrix_cells(rows: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """(poploc, ind, value) of all cells of a matrix, missing ones too."""
    each = rows.select("poploc", "first", F.posexplode("cells").alias("k", value)).select("poploc", (F.col("first") + F.col("k")).alias("place"), value)
    return each.join(index, "place").select("poploc", "ind", value)


def matrix_lines(rows: DataFrame) -> DataFrame:
    """(poploc, line): the matrix as text, parted by tabs."""
    per = rows.groupBy("poploc").agg(F.array_sort(F.collect_list(F.struct("block", F.array_join("cells", "\t").alias("text")))).alias("b"))
    return per.select("poploc", F.concat_ws("\t", F.col("poploc").cast("string"), F.array_join(F.transform("b", lambda x: x["text"]), "\t")).alias("line"))


def matrix(cells: DataFrame, value: str, inds: list) -> DataFrame:
    """One row a locus, one column for each of a few individuals; missing cells are -999."""
    picked = [F.coalesce(F.max(F.when(F.col("ind") == i, F.col(value))), F.lit(MISSING)).alias(str(i)) for i in inds]
    return cells.groupBy("poploc").agg(*picked)


def locus_table(catalogue: DataFrame, sel_loc: DataFrame) -> DataFrame:
    return catalogue.join(sel_loc, "poploc", "left_semi")


def major_allele_count(links: DataFrame, gt: DataFrame) -> DataFrame:
    """Copies of the commonest allele of each locus; a single allele of a genotype counts twice."""
    rows = links.join(gt, ["poploc", "ind"], "left_semi").select("poploc", "ind", "popall").distinct()
    n = F.count(F.lit(1)).over(W.partitionBy("poploc", "ind"))
    copies = rows.withColumn("copies", F.when(n == 1, 2).otherwise(1)).groupBy("poploc", "popall").agg(F.sum("copies").alias("n"))
    return copies.groupBy("poploc").agg(F.max("n").alias("count_maj"))


def locus_table_selected(links: DataFrame, gt: DataFrame, popall: DataFrame) -> DataFrame:
    """The locus table worked out anew from the selected genotypes."""
    rows = links.join(gt, ["poploc", "ind"], "left_semi")
    seen = rows.select("poploc", "popall").distinct().join(popall.select("poploc", "popall", "seq", "sl"), ["poploc", "popall"])
    per = seen.groupBy("poploc", "sl").agg(F.array_sort(F.collect_list("seq")).alias("seqs")).withColumn("pos", S.var_positions(F.col("seqs")))
    n = rows.groupBy("poploc").agg(F.count_distinct("ind").alias("n_ind"), F.count_distinct("ind", "loc").alias("n_indloc"))
    out = per.join(n, "poploc").join(major_allele_count(links, gt), "poploc")
    return out.select("poploc", "sl", S.consensus_iupac(F.col("seqs")).alias("cons"), F.size("pos").alias("n_snp"), S.varpos_text(F.col("pos")).alias("varpos"), F.size("seqs").alias("n_all"), "n_ind", "n_indloc", (F.col("n_indloc") > F.col("n_ind")).cast("int").alias("ties"), "count_maj")


def gt_prune_alleles(links: DataFrame, gt: DataFrame) -> DataFrame:
    """(poploc, popall, popallvar) seen in selected genotypes."""
    return links.join(gt, ["poploc", "ind"], "left_semi").select("poploc", "popall", "popallvar").distinct()


def gt_allele_limit(alleles: DataFrame, limit: int = 99) -> DataFrame:
    """The largest number of alleles of a locus, and whether two-digit formats can hold it."""
    most = alleles.groupBy("poploc").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n_most"))
    return most.withColumn("fits", (F.col("n_most") <= limit).cast("int"))


def gt_drop_invariant(alleles: DataFrame) -> DataFrame:
    """Loci with more than one allele."""
    return alleles.groupBy("poploc").agg(F.count_distinct("popall").alias("n")).filter("n > 1").select("poploc")


def _letters(alleles: DataFrame) -> DataFrame:
    return alleles.filter("popallvar != 'consensus'").select("poploc", "popall", F.posexplode(S.chars(F.col("popallvar"))).alias("pos", "base"))


def gt_first_snp(alleles: DataFrame) -> DataFrame:
    """(poploc, popall, pos, base, code): each allele's base at the first variable position; A, C, G, T are 1 to 4."""
    rows = _letters(alleles)
    first = rows.groupBy("poploc", "pos").agg(F.count_distinct("base").alias("n")).filter("n > 1").groupBy("poploc").agg(F.min("pos").alias("pos"))
    code = F.coalesce(*[F.when(F.col("base") == b, F.lit(i + 1)) for i, b in enumerate("ACGT")], F.lit(0))
    return rows.join(first, ["poploc", "pos"]).select("poploc", "popall", "pos", "base", code.alias("code"))


def gt_biallelic(first_snp: DataFrame) -> DataFrame:
    """Loci with two bases there; 0 for the base fewer alleles have, 1 for the other; ties by letter."""
    n = first_snp.groupBy("poploc", "base").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("poploc")
    ranked = n.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("bin", F.row_number().over(w.orderBy("n", "base")) - 1).filter("k = 2")
    return first_snp.join(ranked.select("poploc", "base", "bin"), ["poploc", "base"]).select("poploc", "popall", "base", F.col("bin").cast("int").alias("bin"))


def gt_trim_varpos(alleles: DataFrame) -> DataFrame:
    """popallvar without positions that do not vary among these alleles."""
    rows = _letters(alleles)
    vary = rows.groupBy("poploc", "pos").agg(F.count_distinct("base").alias("n")).filter("n > 1").drop("n")
    kept = rows.join(vary, ["poploc", "pos"]).groupBy("poploc", "popall").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("a"))
    shown = kept.select("poploc", "popall", F.array_join(F.transform("a", lambda x: x["base"]), "").alias("trimmed"))
    return alleles.join(shown, ["poploc", "popall"], "left").select("poploc", "popall", F.coalesce("trimmed", F.lit("")).alias("trimmed"))


def gt_renumber(alleles: DataFrame) -> DataFrame:
    """(poploc, popall, allele_no), numbered from 1 within the locus."""
    return alleles.withColumn("allele_no", F.row_number().over(W.partitionBy("poploc").orderBy("popall"))).select("poploc", "popall", "allele_no")


def gt_diploid(links: DataFrame, gt: DataFrame, numbers: DataFrame) -> DataFrame:
    """(poploc, ind, a1 <= a2); one allele is doubled, more than two are an error."""
    rows = links.join(gt, ["poploc", "ind"], "left_semi").join(numbers, ["poploc", "popall"]).groupBy("poploc", "ind").agg(F.array_sort(F.collect_set("allele_no")).alias("a"))
    two = F.when(F.size("a") > 2, F.raise_error(F.lit("a genotype has more than two alleles")).cast("int")).otherwise(F.col("a")[0])
    return rows.select("poploc", "ind", two.alias("a1"), F.element_at("a", -1).alias("a2"))


def phase_swaps(seed: int) -> Column:
    """Whether a heterozygote's alleles change places: parity of a hash of seed, individual and locus."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("ind").cast("string"), F.col("poploc").cast("string"))), 1, 1).isin(*"13579bdf")


def phased(links: DataFrame, gt: DataFrame, values: DataFrame, value: str, seed: int = 1) -> DataFrame:
    """(poploc, ind, copy, part): the two copies of each selected genotype, in an order drawn by the seed.

    ``values`` (poploc, popall, value) is what each allele shows; genotypes of
    more than two alleles are an error.
    """
    rows = links.join(gt, ["poploc", "ind"], "left_semi").select("poploc", "ind", "popall").distinct().join(values.select("poploc", "popall", F.col(value).cast("string").alias("v")), ["poploc", "popall"])
    per = rows.groupBy("poploc", "ind").agg(F.array_sort(F.collect_list(F.struct("popall", "v"))).alias("a"))
    first = F.when(F.size("a") > 2, F.raise_error(F.lit("a genotype has more than two alleles")).cast("string")).otherwise(F.col("a")[0]["v"])
    last = F.element_at("a", -1)["v"]
    swap = phase_swaps(seed)
    pair = F.array(F.when(swap, last).otherwise(first), F.when(swap, first).otherwise(last))
    return per.select("poploc", "ind", F.posexplode(pair).alias("copy", "part")).withColumn("copy", F.col("copy") + 1)


def locus_offsets(lengths: DataFrame) -> DataFrame:
    """(poploc, start, end), 1-based, of each locus in the concatenated alignment.

    ``lengths`` (poploc, len) has one row a locus.
    """
    ends = running_sum(lengths.select("poploc", "len"), [F.col("poploc")], F.col("len"), "end")
    return ends.select("poploc", (F.col("end") - F.col("len") + 1).alias("start"), "end")


def alignment(cells: DataFrame, loci: DataFrame, inds: DataFrame, missing: str = "N", copies: int = 2) -> DataFrame:
    """(ind, copy, seq): strings of (poploc, ind, copy, part) joined in locus order, what is missing filled.

    ``loci`` has (poploc, len).  Parts know their place in the alignment, so the
    gap before each one is a run of the missing letter; loci and individuals are
    never crossed.
    """
    offsets = locus_offsets(loci)
    total = offsets.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    placed = cells.join(offsets, "poploc").groupBy("ind", "copy").agg(F.array_sort(F.collect_list(F.struct("start", "end", "part"))).alias("p"))
    rows = inds.select("ind").distinct().withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).join(placed, ["ind", "copy"], "left")
    gap = lambda x, i: x["start"] - 1 - F.when(i > 0, F.get(F.col("p"), i - 1)["end"]).otherwise(0)
    parts = F.transform("p", lambda x, i: F.concat(F.repeat(F.lit(missing), gap(x, i).cast("int")), x["part"]))
    tail = F.repeat(F.lit(missing), (F.lit(total) - F.coalesce(F.try_element_at("p", F.lit(-1))["end"], F.lit(0))).cast("int"))
    return rows.select("ind", "copy", F.concat(F.coalesce(F.array_join(parts, ""), F.lit("")), tail).alias("seq"))


def dosage(links: DataFrame, gt: DataFrame, binary: DataFrame) -> DataFrame:
    """(poploc, ind, dosage): copies (0, 1, 2) of the commoner base of two-base loci."""
    rows = links.join(gt, ["poploc", "ind"], "left_semi").select("poploc", "ind", "popall").distinct().join(binary, ["poploc", "popall"])
    return rows.groupBy("poploc", "ind").agg(F.when(F.count(F.lit(1)) == 1, 2 * F.max("bin")).otherwise(F.sum("bin")).cast("int").alias("dosage"))


def alignment_dosage(dosages: DataFrame, missing: str = "-") -> DataFrame:
    """(ind, seq): dosages joined in locus order."""
    cells = dosages.select("poploc", "ind", F.lit(1).alias("copy"), F.col("dosage").cast("string").alias("part"))
    loci = dosages.select("poploc").distinct().withColumn("len", F.lit(1))
    return alignment(cells, loci, dosages.select("ind"), missing, copies=1).select("ind", "seq")


def seq_indall(links: DataFrame, gt: DataFrame, popall: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(poploc, popall, ind, grp, n_copies, seq): alleles of selected genotypes, 2 copies if alone."""
    rows = links.join(gt, ["poploc", "ind"], "left_semi").select("poploc", "ind", "popall").distinct()
    rows = rows.withColumn("n_copies", F.when(F.count(F.lit(1)).over(W.partitionBy("poploc", "ind")) == 1, 2).otherwise(1))
    rows = rows.join(popall.select("poploc", "popall", "seq"), ["poploc", "popall"])
    rows = rows.withColumn("grp", F.lit("")) if groups is None else rows.join(groups.select("ind", "grp"), "ind", "left").withColumn("grp", F.coalesce("grp", F.lit("")))
    return rows.select("poploc", "popall", "ind", "grp", "n_copies", "seq")


def seq_nonidentical(links: DataFrame, gt: DataFrame, popall: DataFrame) -> DataFrame:
    return seq_indall(links, gt, popall).select("poploc", "popall", "seq").distinct()


def seq_individual(links: DataFrame, gt: DataFrame, popall: DataFrame, with_missing: bool = False, missing: str = "N") -> DataFrame:
    """(poploc, ind, copy, seq): two sequences an individual; optionally rows for missing genotypes."""
    rows = seq_indall(links, gt, popall).groupBy("poploc", "ind").agg(F.array_sort(F.collect_list(F.struct("popall", "seq"))).alias("a"))
    first = F.when(F.size("a") > 2, F.raise_error(F.lit("a genotype has more than two alleles")).cast("string")).otherwise(F.col("a")[0]["seq"])
    two = rows.select("poploc", "ind", F.posexplode(F.array(first, F.element_at("a", -1)["seq"])).alias("copy", "seq"))
    two = two.withColumn("copy", F.col("copy") + 1)
    if not with_missing:
        return two
    # All copies of a locus have one length, so a missing cell is filled by it.
    length = two.groupBy("poploc").agg(F.max(F.length("seq")).alias("len"))
    index = individual_index(gt.select("ind"))
    cells = two.groupBy("poploc", "ind").agg(F.concat_ws("|", F.max(F.when(F.col("copy") == 1, F.col("seq"))), F.max(F.when(F.col("copy") == 2, F.col("seq")))).alias("both"))
    full = matrix_cells(matrix_rows(cells, "both", index, missing=""), index, "both").join(length, "poploc")
    gaps = F.repeat(F.lit(missing), F.col("len"))
    sides = F.when(F.col("both") == "", F.array(gaps, gaps)).otherwise(F.split("both", r"\|"))
    return full.select("poploc", "ind", F.posexplode(sides).alias("copy", "seq")).withColumn("copy", F.col("copy") + 1)


def svars_drilldown(links: DataFrame, svars: DataFrame, allele_seqs: DataFrame) -> DataFrame:
    """(poploc, ind, kind, seq, depth): alleles (depth to 0.1) and used and discarded svars of their loci."""
    a = links.join(allele_seqs.select("ind", "loc", "all_id", "seq"), ["ind", "loc", "all_id"]).select("poploc", "ind", F.lit("allele").alias("kind"), "seq", F.round(F.col("depth").cast("double"), 1).alias("depth"))
    loci = links.select("poploc", "ind", "loc").distinct()
    s = loci.join(svars, ["ind", "loc"]).select("poploc", "ind", F.col("svarcat").alias("kind"), "seq", F.col("depth").cast("double").alias("depth"))
    return a.unionByName(s)
