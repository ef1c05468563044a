"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / q: u is uniform in (0, 1],
a hash of the document, and q its quality weight.  Within a source documents
are taken in ascending order of the key until the source's token budget is
met; a budget above the source's size first takes complete epochs, and only
what is left of it is a fractional, sampled epoch.

The prefix sums need no task that sees a whole source: keys are cut into
``BUCKETS`` ordered buckets, sizes are summed per source and bucket (with
partial sums before the shuffle), the bucket sums are added up in order, and
rows are sorted only within their bucket.  A source that holds a third of all
rows is thus spread over ``BUCKETS`` groups.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; repeated rows are documents of their own; an empty table gives
an empty mix; a source of size 0 gets target 0; texts of any length count whole;
other columns may have any names and are passed on by ``repeated``, of which the
rows come as they are; ids are ordered by their own type, null ids last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuspark.plans.naming import col, fresh
from locuspark.plans.ordering import numbered
from locuspark.plans.scratch import materialize

BUCKETS = 1024
#: Largest number of epochs of a source.
EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, parted by white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight from 0.1 to 1 that falls with the share of symbols and digits."""
    marks = F.length(F.regexp_replace(text, r"[^#*$%&|<>!?=_0-9]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(1 - 0.9 * F.least(5 * marks, F.lit(1.0)), F.lit(1.0))


def exponential_key(seed: int, text: Column, quality_weight: Column, *ids: Column) -> Column:
    """-ln(u) / q with u from a hash of the ids and the text."""
    h = F.xxhash64(F.lit(seed), *ids, text)
    u = (F.shiftrightunsigned(h, 11) + 1) / F.lit(float(1 << 53))
    return -F.ln(u) / quality_weight


def cyclic_weights(position: Column, weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights that repeat along the order of the sources."""
    return F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int")).cast("double")


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (size, weight) with the share of all sizes each one gets.

    Shares are by weight; what a source would get beyond ``epochs`` times its
    size is shared anew by weight until none is above.  Each round sends three
    numbers to the driver.
    """
    total, weight = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate, known = (total / weight if weight else 0.0), -1
    while True:
        full = F.col("size") * epochs <= F.col("weight") * rate
        n, kept, left = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("size") * epochs)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == known or not left:
            break
        rate, known = (total - kept) / left, n
    return sources.withColumn("target", F.least((F.col("size") * epochs).cast("double"), F.col("weight") * F.lit(float(rate))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_weight: Column | None = None, weight_of=cyclic_weights, seed: int = 7, cut: bool = True) -> DataFrame:
    """What the mix takes of each document.

    Columns: the id, source, size, source_size, target, taken, epochs (times
    the document is begun) and text_hash.  ``weight_of`` maps a source's
    0-based position in code-point order to its weight.  With ``cut`` the one
    document of a source that crosses the budget gives only the words that are
    missing; without it, that document is taken whole if this comes nearer to
    the budget, and left out otherwise.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), text.alias("_text"), *([] if quality_weight is None else [quality_weight.alias("_q")]))
    q = quality(F.col("_text")) if quality_weight is None else F.col("_q")
    rows = rows.select("_id", "_source", F.xxhash64("_text").alias("_hash"), word_count(F.col("_text")).alias("_size"), exponential_key(seed, F.col("_text"), q, F.col("_id")).alias("_key"))
    slim = materialize(rows.withColumn("_bucket", F.floor(BUCKETS * (1 - F.exp(-0.8 * F.col("_key")))).cast("int")))
    sums = materialize(slim.groupBy("_source", "_bucket").agg(F.sum("_size").alias("in_bucket")))
    sources = numbered(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("in_bucket").alias("size")), [F.col("source").asc_nulls_last()])
    sources = materialize(targets(sources.withColumn("weight", weight_of(F.col("row_no")))))
    plan = sums.join(sources, F.col("_source").eqNullSafe(F.col("source")))
    budget = F.round("target").cast("long")
    whole = F.coalesce(F.floor(budget / F.nullif(F.col("size"), F.lit(0))), F.lit(0)).cast("long")
    plan = plan.select(
        "_source", "_bucket", F.col("size").alias("source_size"), "target", whole.alias("full"), (budget - whole * F.col("size")).alias("rest"),
        (F.sum("in_bucket").over(W.partitionBy("_source").orderBy("_bucket")) - F.col("in_bucket")).alias("before"),
    )
    p = plan.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "source_size", "target", "full", "rest", "before")
    both = slim.join(p, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    order = W.partitionBy("_source", "_bucket").orderBy("_key", F.col("_id").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_left", F.col("rest") - F.col("before") - F.sum("_size").over(order) + F.col("_size"))
    if cut:
        extra = F.greatest(F.lit(0), F.least("_left", "_size"))
    else:
        extra = F.when((F.col("_left") > 0) & (2 * F.col("_left") >= F.col("_size")), F.col("_size")).otherwise(0)
    more = both.withColumn("_extra", extra.cast("long"))
    return more.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), "source_size", "target",
        (F.col("full") * F.col("_size") + F.col("_extra")).alias("taken"), (F.col("full") + (F.col("_extra") > 0).cast("long")).alias("epochs"), F.col("_hash").alias("text_hash"),
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, whole."""
    hashed, own_id, own_source, own_hash, n, n_rows, copy = fresh(docs.columns, "hash", "id", "source", "own_hash", "n", "n_rows", "copy")
    slim = docs.select(col(id_col).alias("i"), col(text_col).alias("t"), col(source_col).alias("s"))
    plan = mix(slim, "i", "t", "s", cut=False, **settings).filter("epochs > 0")
    plan = plan.groupBy(F.col("i").alias(own_id), F.col("s").alias(own_source), F.col("text_hash").alias(own_hash)).agg(F.sum("epochs").alias(n), F.count(F.lit(1)).alias(n_rows))
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce(col(text_col).cast("string"), F.lit(""))))
    both = rows.join(plan.hint("shuffle_hash"), (col(hashed) == col(own_hash)) & col(id_col).eqNullSafe(col(own_id)) & col(source_col).cast("string").eqNullSafe(col(own_source)))
    # Equal rows share what the mix takes of them; the rounding is up.
    times = F.ceil(col(n) / col(n_rows)).cast("int")
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*[col(c) for c in docs.columns])
