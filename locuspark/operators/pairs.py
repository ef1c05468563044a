"""Loci linked by read pairs: pair counts, self matches and groups of loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.operators.components import connected_components
from locuspark.plans.ordering import ranked


def pair_key(header: str = "read_id") -> Column:
    """The read's header without its fifth field, which tells the mates apart."""
    parts = F.split(header, "_")
    return F.array_join(F.concat(F.slice(parts, 1, 4), F.slice(parts, 6, 1000)), "_")


def read_pair_join(reads: DataFrame) -> DataFrame:
    """(ind, loc1 <= loc2) of the two reads that share (ind, pair_key).

    A key with three or more reads is an error, as reads come in pairs.
    """
    both = reads.groupBy("ind", "pair_key").agg(F.count(F.lit(1)).alias("n"), F.min("poploc").alias("loc1"), F.max("poploc").alias("loc2"))
    checked = F.when(F.col("n") > 2, F.raise_error(F.lit("more than two reads share a key")).cast("long")).otherwise(F.col("n"))
    return both.filter(checked == 2).select("ind", "loc1", "loc2")


def pair_counts(linked: DataFrame) -> DataFrame:
    return linked.filter("loc1 != loc2").groupBy("loc1", "loc2").agg(F.count(F.lit(1)).alias("n_seqpairs"), F.count_distinct("ind").alias("n_ind"))


def self_match(linked: DataFrame) -> DataFrame:
    return linked.filter("loc1 = loc2").groupBy(F.col("loc1").alias("poploc")).agg(F.count(F.lit(1)).alias("n_seqpairs"), F.count_distinct("ind").alias("n_ind"))


def pair_groups(pairs: DataFrame, loci: DataFrame) -> DataFrame:
    """(first, poploc): components over pairs, and loci without a pair alone."""
    found = connected_components(pairs.select(F.col("loc1").alias("a"), F.col("loc2").alias("b")))
    return loci.select("poploc").distinct().join(found.withColumnRenamed("node", "poploc"), "poploc", "left").select(F.coalesce("component", "poploc").alias("first"), "poploc")


def poison_groups(groups: DataFrame, selfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups without a self-matching locus, and all self matches with those of the groups removed."""
    marked = groups.join(selfs, "poploc", "left").withColumn("bad", F.max(F.col("n_seqpairs").isNotNull()).over(W.partitionBy("first")))
    clean = marked.filter("not bad").select("first", "poploc")
    return clean, marked.filter("bad").select("poploc", F.coalesce("n_seqpairs", F.lit(0)).cast("long").alias("n_seqpairs"), F.coalesce("n_ind", F.lit(0)).cast("long").alias("n_ind"))


def loc_groups(groups: DataFrame) -> DataFrame:
    """(loc_group, n_loc, poploc), groups numbered from 1 by their first locus."""
    n = F.count(F.lit(1)).over(W.partitionBy("first"))
    return ranked(groups.withColumn("n_loc", n), ["first"], "loc_group").select("loc_group", "n_loc", "poploc")


def group_size_hist(groups: DataFrame) -> DataFrame:
    return groups.groupBy("first").agg(F.count(F.lit(1)).alias("n_loc")).groupBy("n_loc").agg(F.count(F.lit(1)).alias("n_groups"))
