"""Selections of individuals, loci and genotypes; they only ever narrow.

A selection is three key sets: individuals (ind), loci (poploc) and genotypes
(poploc, ind).  Predicates on loci, and those on genotypes, are each a
conjunction over facts of the incoming selection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.functions import sequence as S


@dataclass(frozen=True)
class Selection:
    """Key sets; ``gt`` holds the selected genotypes."""

    ind: DataFrame
    loc: DataFrame
    gt: DataFrame

    @classmethod
    def default(cls, loci_links: DataFrame) -> Selection:
        """Everything that was genotyped."""
        gt = loci_links.select("poploc", "ind").distinct()
        return cls(gt.select("ind").distinct(), gt.select("poploc").distinct(), gt)

    def restrict(self, ind: DataFrame | None = None, loc: DataFrame | None = None, gt: DataFrame | None = None) -> Selection:
        """Narrow by any of the sets; then drop loci and individuals without genotypes."""
        new = self.gt
        if ind is not None:
            new = new.join(ind.select("ind").distinct(), "ind", "left_semi")
        if loc is not None:
            new = new.join(loc.select("poploc").distinct(), "poploc", "left_semi")
        if gt is not None:
            new = new.join(gt.select("poploc", "ind").distinct(), ["poploc", "ind"], "left_semi")
        return Selection(drop_empty(self.ind, new, "ind"), drop_empty(self.loc, new, "poploc"), new)


def drop_empty(keys: DataFrame, gt: DataFrame, key: str) -> DataFrame:
    """Keys that have a genotype."""
    return keys.join(gt.select(key).distinct(), key, "left_semi")


def exclude_split(sel: Selection, split: DataFrame) -> Selection:
    """Without split loci, and then without individuals left empty."""
    return sel.restrict(loc=sel.loc.join(split.select("poploc").distinct(), "poploc", "left_anti"))


def genotype_facts(links: DataFrame, loci_links: DataFrame, ind_loci: DataFrame) -> DataFrame:
    """Facts of each (poploc, ind): allele depths, locus depth, numbers of alleles."""
    a = links.groupBy("poploc", "ind").agg(F.sum("depth").cast("double").alias("all_dep"), F.count_distinct("loc", "all_id").alias("n_all"), F.min("depth").cast("double").alias("least_dep"), F.count_distinct("loc").alias("n_indloc"))
    dep = loci_links.join(ind_loci.select("ind", "loc", "loc_dep"), ["ind", "loc"]).groupBy("poploc", "ind").agg(F.sum("loc_dep").cast("double").alias("tot_dep"))
    both = a.join(dep, ["poploc", "ind"])
    minor = F.when(F.col("n_all") == 1, F.col("all_dep") / 2).otherwise(F.col("least_dep"))
    return both.withColumn("minor_dep", minor).withColumn("frac_used", F.col("all_dep") / F.col("tot_dep"))


def locus_facts(gt: DataFrame, links: DataFrame, facts: DataFrame, popall: DataFrame) -> DataFrame:
    """Facts of each locus over the selected genotypes."""
    chosen = facts.join(gt, ["poploc", "ind"], "left_semi")
    per = chosen.groupBy("poploc").agg(F.count(F.lit(1)).alias("n_ind"), F.max("n_all").alias("n_all_ind"), F.sum("n_indloc").alias("n_indloc"), F.min("frac_used").alias("least_frac"))
    seen = links.join(gt, ["poploc", "ind"], "left_semi").select("poploc", "popall").distinct()
    seqs = seen.join(popall.select("poploc", "popall", "seq", "sl"), ["poploc", "popall"]).groupBy("poploc", "sl").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    own = seqs.select("poploc", "sl", F.size("seqs").alias("n_all"), F.size(S.var_positions(F.col("seqs"))).alias("n_snp"))
    return per.join(own, "poploc").withColumn("ties", (F.col("n_indloc") > F.col("n_ind")).cast("int"))


def loc_between(facts: DataFrame, column: str, least: float, most: float) -> DataFrame:
    return facts.filter(F.col(column).between(least, most)).select("poploc")


def loc_pairs(sel_loc: DataFrame, groups: DataFrame, selfs: DataFrame) -> DataFrame:
    """Loci of groups of two, the first one that is selected, without self matches."""
    two = groups.filter("n_loc = 2").join(sel_loc, "poploc", "left_semi").join(selfs.select("poploc"), "poploc", "left_anti")
    return two.withColumn("rank", F.row_number().over(W.partitionBy("loc_group").orderBy("poploc"))).filter("rank = 1").select("poploc")


def loc_depth(sel_loc: DataFrame, da: DataFrame, criteria: list[tuple[int, int, str, float]]) -> DataFrame:
    """Loci within the depth criterion (min length, max length, column, limit) of their length.

    ``*_scaldep`` must be at most, ``*_dep_perc`` at least the limit.  Loci
    without depth data or outside all lengths stay.
    """
    ok: Column = F.lit(True)
    for lo, hi, column, limit in reversed(criteria):
        good = F.col(column) <= limit if column.endswith("scaldep") else F.col(column) >= limit
        ok = F.when(F.col("sl").between(lo, hi), F.coalesce(good, F.lit(True))).otherwise(ok)
    rows = sel_loc.join(da, "poploc", "left")
    return rows.filter(F.col("sl").isNull() | ok).select("poploc")


def selection_report(before: Selection, after: Selection) -> DataFrame:
    """Numbers of individuals, loci and genotypes before and after."""
    spark = before.gt.sparkSession
    rows = [(what, getattr(before, what).count(), getattr(after, what).count()) for what in ("ind", "loc", "gt")]
    return spark.createDataFrame(rows, "what string, n_before long, n_after long")
