"""Document fingerprints by winnowing.

Every run of ``K`` code points is hashed by a rolling polynomial hash; of each
window of ``WINDOW`` neighbouring hashes the smallest is kept, the rightmost one
on ties, together with its position.  Two texts that share a run of at least
WINDOW + K - 1 code points therefore share at least one kept hash.  The window
is the same for all texts, so that any two fingerprints can be compared.

Defined cases: a null text counts as empty and has no hash; a text of fewer
than ``K`` code points is one hash of the whole text; one of fewer hashes than a
window has a single window, and so keeps one; two empty fingerprints have
likeness 1, an empty and a non-empty one 0.  Ids may be numbers, strings, dates
or times; null ids come last, rows with equal ids go by a hash of their text,
and repeated rows follow each other.  Texts are taken whole, whatever their
length, in overlapping blocks.  An empty table gives no row.  Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType

from locuspark.llm.arrays import U64, mix, powers, running
from locuspark.plans.naming import col
from locuspark.plans.scratch import input_partitions

K = 16
WINDOW = 32
_POS = U64((1 << 22) - 1)
_BLOCK = 1 << 20
#: Code points of texts whose rows are sent on together.
_SENT = 1 << 20


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def rolling(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k code points."""
    n = len(points)
    up, down = powers(n + 1)
    p = running(points.astype(U64) + U64(1), up[:n])
    return mix((p[k:] - p[:-k]) * down[: n - k + 1])


def window_for(n_grams: int, largest: int = WINDOW) -> int:
    """The window, or all grams if they are fewer."""
    return min(largest, n_grams)


def lowest(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w keys, by doubling."""
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    return np.minimum(key[: len(key) - (w - span)], key[w - span :]) if span < w else key


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, in order of position."""
    n = len(points)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if n < k:
        return rolling(points, n), np.zeros(1, np.int64)
    g = n - k + 1
    w = window_for(g, window)
    hashes, places = [], []
    for a in range(0, g - w + 1, _BLOCK):
        h = rolling(points[a : min(n, a + _BLOCK + w + k - 2)], k)
        local = np.arange(len(h), dtype=U64)
        m = lowest((h & ~_POS) | (_POS - local), w)
        at = (_POS - (m & _POS)).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        hashes.append(h[at])
        places.append(at + a)
    if len(places) == 1:
        return hashes[0], places[0]
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of kept hashes, each sorted and distinct."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def text_of(hashes: np.ndarray) -> str:
    """Kept hashes in order of position, 16 hexadecimal digits each."""
    return hashes.astype(">u8").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint and positions of each row; no shuffle.

    Columns other than the two named are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [codes(t or "") for t in b.column(1).to_pylist()]
            kept = [winnow(c) for c in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(c) for c in got], pa.int64()), pa.array([text_of(h) for h, _ in kept], pa.string()), _lists([p for _, p in kept])],
                names=["id", "n_chars", "fingerprint", "positions"],
            )

    out = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_chars long, fingerprint string, positions array<long>")
    return out.withColumnRenamed("id", id_col)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def placed(id_col: Column, kind: DataType, prefix: str = "") -> Column:
    """A number that never falls as ids rise; null for null ids.

    Strings go by the six bytes after ``prefix``, which all of them begin with.
    """
    if isinstance(kind, StringType):
        six = F.rpad(F.substring(F.hex(F.substring(id_col.cast("binary"), len(prefix.encode()) + 1, 6)), 1, 12), 12, "0")
        return F.when(id_col.isNotNull(), F.conv(six, 16, 10).cast("double"))
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(id_col.cast("timestamp")).cast("double")
    return (F.datediff(id_col, F.lit("1970-01-01")) if isinstance(kind, DateType) else id_col).cast("double")


def with_successor_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into runs of neighbouring ids, each run closed by its successor.

    Rows (id, text, run, tail), sorted within each partition by run, tail and
    id; the one row with tail = 1 that ends a run repeats the first row of the
    next run (of the first run, after the last).  One shuffle of the texts; a run
    is a partition of its own.  There are about twice as many runs as the scan has
    partitions: quantiles of the ids part them, and null ids are parted by the
    hash of their text that orders them.  What the driver and the broadcast hold
    is one number and one row for each run.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    n = input_partitions(docs)
    count = rows.agg(F.count(F.lit(1)).alias("all"), F.count("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    prefix = os.path.commonprefix([count["low"] or "", count["high"] or ""]) if isinstance(kind, StringType) else ""
    rows = rows.withColumn("place", placed(F.col("id"), kind, prefix)).withColumn("tie", F.xxhash64("text"))
    runs = max(1, 2 * n * count["ids"] // max(1, count["all"]))
    cuts = sorted({float(x) for x in rows.approxQuantile("place", [i / runs for i in range(1, runs)], 0.2 / runs)}) if runs > 1 else []
    if cuts:
        rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="bucket", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    spare = max(1, 2 * n - runs)
    null_run = (F.col("tie") / F.lit(2.0**64 / spare) + spare / 2).cast("int")
    of_null = F.lit(len(cuts) + 1) + F.greatest(F.lit(0), F.least(F.lit(spare - 1), null_run))
    rows = rows.withColumn("run", F.when(F.col("place").isNull(), of_null).otherwise(F.col("bucket").cast("int"))).drop("bucket", "place")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("tie"))
    heads = rows.groupBy("run").agg(F.min(order).alias("head")).select(F.lit(0).alias("one"), "run", F.col("head.id").alias("head_id"), F.col("head.tie").alias("head_tie"))
    # One row for each run: small enough for a window and a broadcast.
    around = W.partitionBy("one").orderBy("run")
    last = F.last("run").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select(F.coalesce(F.lag("run").over(around), last).alias("to"), "head_id", "head_tie")
    copies = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    copies = copies.select("id", "text", "tie", F.col("to").alias("run"), F.lit(1).alias("tail"))
    both = rows.select("id", "text", "tie", "run", F.lit(0).alias("tail")).unionByName(copies)
    dealt = both.repartitionById(len(cuts) + 1 + spare, "run").sortWithinPartitions("tail", F.col("id").asc_nulls_last(), "tie")
    return dealt.select("id", "text", "run", "tail")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of what follows."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n/4) code points replaced by the first
    as many of the text that follows in ascending order of the id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, text, kept hashes, positions, distinct hashes, run

        def row(now: tuple, then_text: str, then_set: np.ndarray) -> tuple:
            new = edited(now[1], then_text)
            kept, _ = (now[2], None) if new == now[1] else winnow(codes(new))
            return (now[0], len(now[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_of(now[2]), text_of(kept), likeness(now[4], np.unique(kept)), likeness(now[4], then_set), now[3])

        def sent(out: list[tuple], first: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            types = [first, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=False)), _lists(list(cols[7]))], names=names)

        for b in batches:
            out, size = [], 0
            for key, text, at, tail in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if tail and held is None:
                    continue
                h, p = winnow(codes(text))
                now = (key, text, h, p, np.unique(h), at)
                if held is not None:
                    out.append(row(held, text, now[4]))
                held = None if tail else now
                size += len(text)
                if size > _SENT and out:
                    yield sent(out, b.schema.field(0).type)
                    out, size = [], 0
            if out:
                yield sent(out, b.schema.field(0).type)

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>"
    runs = with_successor_runs(docs, id_col, text_col)
    return runs.select("id", "text", "run", "tail").mapInArrow(run, schema).withColumnRenamed("id", id_col)
