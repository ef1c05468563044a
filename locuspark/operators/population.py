"""The catalogue of loci and alleles over all individuals, and links to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.operators.components import connected_components
from locuspark.operators.similarity import similar_pairs
from locuspark.plans.ordering import ranked


def pool_alleles(alleles: DataFrame) -> DataFrame:
    """(ind, loc, all_id, seq, ...) to (seq, sl, n_founders): distinct sequences of all individuals."""
    return alleles.filter("seq is not null and seq != '0'").groupBy("seq").agg(F.count_distinct("ind", "loc", "all_id").alias("n_founders")).select("seq", F.length("seq").alias("sl"), "n_founders")


def pop_loci(pool: DataFrame, d: Column | int) -> DataFrame:
    """(poploc, popall, seq, sl): components of plain Hamming distance at most d.

    Ids are ranks from 1: of (sl, least sequence) for loci, (sl, sequence) for
    alleles.
    """
    pairs = similar_pairs(pool, [], "seq", d, ignore_n=False)
    found = connected_components(pairs.select(F.col("seq1").alias("a"), F.col("seq2").alias("b")))
    named = pool.join(found.withColumnRenamed("node", "seq"), "seq", "left").withColumn("first", F.coalesce("component", "seq"))
    return ranked(ranked(named, ["sl", "first"], "poploc"), ["sl", "seq"], "popall").select("poploc", "popall", "seq", "sl")


def catalogue(popall: DataFrame) -> DataFrame:
    """Per locus: sl, cons, n_snp, varpos, n_all; seqs and pos for further use."""
    per = popall.groupBy("poploc", "sl").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    per = per.withColumn("pos", S.var_positions(F.col("seqs")))
    return per.select("poploc", "sl", S.consensus_iupac(F.col("seqs")).alias("cons"), F.size("pos").alias("n_snp"), S.varpos_text(F.col("pos")).alias("varpos"), F.size("seqs").alias("n_all"), "pos")


def with_popallvar(popall: DataFrame) -> DataFrame:
    """popall with the letters at the variable positions; ``consensus`` where there are none."""
    pos = catalogue(popall).select("poploc", "pos")
    return popall.join(pos, "poploc").select("poploc", "popall", "seq", "sl", F.when(F.size("pos") == 0, "consensus").otherwise(S.var_chars(F.col("seq"), F.col("pos"))).alias("popallvar"))


def link_alleles(alleles: DataFrame, popall: DataFrame) -> DataFrame:
    """(ind, loc, all_id, poploc, popall, popallvar, depth) of individual alleles found in the catalogue."""
    p = popall.select("poploc", "popall", F.col("seq").alias("_seq"), "popallvar")
    return alleles.join(p, F.col("seq") == F.col("_seq")).select("ind", "loc", "all_id", "poploc", "popall", "popallvar", "depth")


def link_loci(links: DataFrame) -> DataFrame:
    return links.select("ind", "loc", "poploc").distinct()


def split_loci(loci_links: DataFrame) -> DataFrame:
    """(poploc, ind, loc) of individual loci that fall into several population loci."""
    several = loci_links.groupBy("ind", "loc").agg(F.count_distinct("poploc").alias("n")).filter("n > 1").drop("n")
    return loci_links.join(several, ["ind", "loc"], "left_semi").select("poploc", "ind", "loc")


def poploc_stats(links: DataFrame) -> DataFrame:
    """n_ind, n_indloc and ties (more individual loci than individuals) of each locus."""
    s = links.groupBy("poploc").agg(F.count_distinct("ind").alias("n_ind"), F.count_distinct("ind", "loc").alias("n_indloc"))
    return s.withColumn("ties", (F.col("n_indloc") > F.col("n_ind")).cast("int"))


def merge_settings(msl: int, spl: int, least: int = 10) -> tuple[int, int] | None:
    """Least and greatest overlap of halves, or None if merging is off."""
    if msl % 2 or not msl // 2 <= spl <= msl:
        raise ValueError("msl must be even, and spl from half of it to all of it")
    return (least, msl - spl) if least <= msl - spl else None


def merge_halves(popall: DataFrame, msl: int, least: int, most: int) -> DataFrame:
    """Per allele: merged sequence; per locus: lon_over, lon_com_over, conflict, new sl.

    For loci of length msl: the longest overlap of halves that some allele has,
    the longest one that all have, and the sequence without its second copy.
    """
    rows = popall.withColumn("over", F.when(F.col("sl") == msl, S.half_overlaps(F.col("seq"), least, most)).otherwise(F.array(F.lit(0))))
    each = rows.select("poploc", "popall", F.explode("over").alias("o"))
    size = rows.groupBy("poploc").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy("poploc", "o").agg(F.count(F.lit(1)).alias("k")).join(size, "poploc")
    per = per.groupBy("poploc").agg(F.max("o").alias("lon_over"), F.max(F.when(F.col("k") == F.col("n"), F.col("o"))).alias("lon_com_over"))
    half = F.floor(F.col("sl") / 2).cast("int")
    merged = F.concat(F.substr("seq", F.lit(1), half), F.substr(F.col("seq"), half + 1 + F.col("lon_com_over")))
    return rows.join(per, "poploc").select("poploc", "popall", merged.alias("merged"), "lon_over", "lon_com_over", (F.col("lon_over") != F.col("lon_com_over")).cast("int").alias("merge_conflict"), (F.col("sl") - F.col("lon_com_over")).alias("new_sl"))
