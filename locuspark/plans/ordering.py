"""Numbers and sums along a global order without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.plans.scratch import materialize


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one in ``order``, as a long column.

    Rows are dealt by range and summed per range (one number for each range goes
    to the driver), then within their range.  Rows that tie come in some order.
    """
    ranged = materialize(df.withColumn("_value", value.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum("_value")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_range")) if before else F.lit(0)
    own = F.sum("_value").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, (base + own).cast("long")).drop("_range", "_value")


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """``df`` with its 0-based position in ``order`` as a long column."""
    return running_sum(df, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with the 1-based rank of its (non-null) keys among all different ones."""
    ranks = numbered(df.select(*keys).distinct(), [F.col(k) for k in keys], name).withColumn(name, F.col(name) + 1)
    return df.join(ranks, keys)
