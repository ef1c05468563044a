"""Lineage cuts that survive lost executors.

Intermediate tables go, as Parquet, to the folder the cluster names in
``spark.checkpoint.dir``: every executor can read it, so a lost executor costs
a re-read and no recomputation.  Only in local mode, and only if the setting
is missing, a temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="locuspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the scratch folder and read back.

    The rows are those of ``df``; the plan of the result is a plain scan.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_partitions(df: DataFrame) -> int:
    """Number of partitions the scan of ``df`` is planned with (at least 1)."""
    return max(1, df.rdd.getNumPartitions())
