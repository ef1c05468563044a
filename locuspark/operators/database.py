"""A genotype database that grows by runs.

Every run has a name and adds its individuals to tables parted by it.  A run
overwrites its own part alone, and its individuals count from the moment they
are in the table of commits, which is written last: a run that was broken off
leaves nothing behind that is read, and is repeated under its name.  A run that is
committed is not done again.

An individual that fails is set aside with the reason; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.plans.scratch import materialize

COMMITS = "batch string, ind {ind}, success int, reason string, n_loci long"


def _commits(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = COMMITS.format(ind=kind)
    try:
        return spark.read.schema(schema).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def status(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(batch, ind, success, reason, n_loci) of every individual of every committed run; ``kind`` is the ids' type."""
    return _commits(spark, path, kind)


def table(spark: SparkSession, path: str, name: str, kind: str = "long") -> DataFrame:
    """A table of the database: rows of individuals that were committed with success, without the run."""
    good = status(spark, path, kind).filter("success = 1").select("batch", "ind")
    return spark.read.parquet(f"{path}/{name}").join(good, ["batch", "ind"], "left_semi").drop("batch")


def faults(reads: DataFrame, listed: DataFrame) -> DataFrame:
    """(ind, reason) of every listed individual; the reason is null if its reads can be used."""
    odd = F.col("seq").isNull() | (F.length(F.translate("seq", "ACGTN", "")) > 0)
    found = reads.groupBy("ind").agg(F.count_if(odd).alias("odd"))
    reason = F.when(F.col("odd").isNull(), "no reads").when(F.col("odd") > 0, "letters other than ACGTN")
    return listed.select("ind").distinct().join(found, "ind", "left").select("ind", reason.alias("reason"))


def append(path: str, batch: str, reads: DataFrame, listed: DataFrame, call: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
    """Adds the listed individuals with their reads (ind, seq) as run ``batch``; gives their rows of ``status``.

    ``call`` makes the run's tables, by name, of reads that can be used; all have
    ``ind``, and ``loci`` tells who succeeded.  An individual that another run
    committed with success is refused, as ids must not repeat; one that failed
    there may come again.  No read is an error of the individual, not of the run.
    """
    spark, kind = reads.sparkSession, reads.schema["ind"].dataType.simpleString()
    known = status(spark, path, kind)
    if not known.filter(F.col("batch") == batch).isEmpty():
        return known.filter(F.col("batch") == batch)
    twice = [r[0] for r in known.filter("success = 1").join(listed.select("ind"), "ind", "left_semi").select("ind").limit(5).collect()]
    if twice:
        raise ValueError(f"individuals of other runs: {', '.join(map(str, twice))}")
    state = materialize(faults(reads, listed))
    usable = reads.join(state.filter("reason is null").select("ind"), "ind", "left_semi")
    for name, rows in call(usable).items():
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")
    loci = spark.read.parquet(f"{path}/loci").filter(F.col("batch") == batch).groupBy("ind").agg(F.count(F.lit(1)).alias("n_loci"))
    out = state.join(loci, "ind", "left").withColumn("n_loci", F.when(F.col("reason").isNull(), F.coalesce("n_loci", F.lit(0))).otherwise(0).cast("long"))
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("n_loci") == 0, "no locus")))
    out = out.select("ind", F.col("reason").isNull().cast("int").alias("success"), "reason", "n_loci", F.lit(batch).alias("batch"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/commits")
    return status(spark, path, kind).filter(F.col("batch") == batch)
