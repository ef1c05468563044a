"""Depth statistics of loci (or clusters of them) within and over individuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cluster_units(loci: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(poploc, unit, unit_sl) of (poploc, sl): the cluster, or the locus itself; the longest length."""
    if clusters is None:
        return loci.select("poploc", F.col("poploc").alias("unit"), F.col("sl").alias("unit_sl"))
    rows = loci.join(clusters.select("poploc", "cluster"), "poploc", "left")
    rows = rows.withColumn("unit", F.coalesce("cluster", F.raise_error(F.concat(F.lit("no cluster for locus "), F.col("poploc").cast("string"))).cast("long")))
    return rows.select("poploc", "unit", F.max("sl").over(W.partitionBy("unit")).alias("unit_sl"))


def unit_depth(loci_links: DataFrame, ind_loci: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, unit_sl, ind, dep): summed depth of the individual loci of a unit."""
    rows = loci_links.join(ind_loci.select("ind", "loc", "loc_dep"), ["ind", "loc"]).join(units, "poploc")
    return rows.groupBy("unit", "unit_sl", "ind").agg(F.sum("loc_dep").alias("dep"))


def scaled(depths: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Scaled depth and percentile of each unit within its length range and individual.

    scaldep is (dep - min) / (max - min), null if all are equal; dep_perc is
    the percentage of units with a greater depth.  Ranges may overlap.
    """
    r = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("range_no"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(ranges)]), lambda x: F.col("unit_sl").between(x["lo"], x["hi"])))
    rows = depths.select("*", r.alias("r")).withColumn("range_no", F.col("r.range_no")).drop("r")
    w = W.partitionBy("range_no", "ind")
    least, most = F.min("dep").over(w), F.max("dep").over(w)
    return rows.select("range_no", "unit", "ind", "dep", ((F.col("dep") - least) / F.nullif(most - least, F.lit(0))).alias("scaldep"), (100 * (1 - F.cume_dist().over(w.orderBy("dep")))).alias("dep_perc"))


def min_med_max(rows: DataFrame) -> DataFrame:
    """Minimum, median and maximum of both figures of each unit over individuals."""
    out = [f(c).alias(f"{n}_{c}") for c in ("scaldep", "dep_perc") for n, f in (("min", F.min), ("med", F.median), ("max", F.max))]
    return rows.groupBy("range_no", "unit").agg(*out)


def all_loci(stats: DataFrame, units: DataFrame) -> DataFrame:
    """The figures of each locus; of overlapping ranges the last one counts."""
    last = stats.withColumn("rank", F.row_number().over(W.partitionBy("unit").orderBy(F.desc("range_no")))).filter("rank = 1").drop("rank")
    return units.join(last, "unit").select("poploc", F.col("unit_sl").alias("sl"), *[c for c in last.columns if c not in ("unit", "range_no")])
