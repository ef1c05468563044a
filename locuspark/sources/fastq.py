"""FASTQ files, plain or gzip, single or in pairs, read and written by Spark's text source.

Files may lie in any store that Spark reads.  Plain files are split among
tasks, gzip files are one split each.  A first pass counts the lines of each
split and keeps the few at its ends; so every split knows at which line of a
record it begins, and a second pass forms records within their splits, without a
shuffle.  Only records that lie across an end of a split are put together by a
join of those few lines.  If all files are gzip, there is nothing to join, and one
pass does.  Writing is one text row a record, so it needs no
shuffle either, and records can be parted into folders by any columns.

``spark.read.format("fastq")`` is the same for files that the executors see by
local paths, one partition a file and without a shuffle.
"""

from __future__ import annotations

import gzip
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locuspark.plans.naming import col
from locuspark.plans.scratch import materialize

PARTS = ("header", "seq", "plus", "qual")
SCHEMA = "file_no int, record_no long, header string, seq string, plus string, qual string"
#: Records that the data source hands on together.
BATCH = 10_000
#: Most splits of which the line counts (16 bytes each) are broadcast; beyond, they are joined.
SPLITS = 1 << 20


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class FastqReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        open_ = gzip.open if partition.path.endswith(".gz") else open
        schema = pa.schema([("file_no", pa.int32()), ("record_no", pa.int64()), *((c, pa.string()) for c in PARTS)])
        with open_(partition.path, "rt", encoding="utf-8", newline="\n") as f:
            done = 0
            while lines := [s.rstrip("\r\n") for s in itertools.islice(f, 4 * BATCH)]:
                while lines and not lines[-1] and len(lines) % 4:
                    lines.pop()  # blank lines at the end of the file
                n = len(lines) // 4
                if len(lines) % 4 or any(not h.startswith("@") for h in lines[::4]):
                    raise ValueError(f"{partition.path}: a record after number {done} is not complete")
                yield pa.RecordBatch.from_arrays([pa.array([partition.number] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), *(pa.array(lines[k::4], pa.string()) for k in range(4))], schema=schema)
                done += n


class FastqSource(DataSource):
    """Files named in the option ``path``, parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader([p.strip() for p in self.options["path"].split(",") if p.strip()])


def register(spark: SparkSession) -> None:
    """Let ``spark.read.format("fastq")`` be known."""
    spark.dataSource.register(FastqSource)


def _whole(keys: list[str]):
    """Records of files that are one split each, and what is left at the end of a file as a record of ``n`` < 4 lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, carry, own = None, 0, None, []

        def out(n: int, each: list[pa.Array], lines: int) -> pa.RecordBatch:
            same = [pa.concat_arrays([x] * n) for x in own]
            return pa.RecordBatch.from_arrays([*same, pa.array([now] * n, pa.int64()), pa.array(range(at // 4, at // 4 + n), pa.int64()), *each, pa.array([lines] * n, pa.int64())], names=[*keys, "file", "record_no", *PARTS, "n"])

        def rest() -> Iterator[pa.RecordBatch]:
            if carry is not None and len(carry):
                yield out(1, [carry.slice(k, 1) if k < len(carry) else pa.array([None], pa.string()) for k in range(4)], len(carry))

        for batch in batches:
            ids = batch.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in itertools.pairwise(cuts):
                value = batch.column("value").slice(a, b - a)
                if int(ids[a]) != now:
                    yield from rest()
                    now, at, carry, own = int(ids[a]), 0, None, [batch.column(k).slice(a, 1) for k in keys]
                if carry is not None and len(carry):
                    value = pa.concat_arrays([carry, value])
                n = len(value) // 4
                carry = value.slice(4 * n)
                if n:
                    yield out(n, [value.take(pa.array(range(k, 4 * n, 4), pa.int64())) for k in range(4)], 4)
                    at += 4 * n
        yield from rest()

    return run


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(split, first row, last row + 1) of the rows of one split that come together."""
    n, split = batch.num_rows, lambda k: (batch.column("path")[k].as_py(), batch.column("start")[k].as_py())
    # Rows of a split are not mixed with others, so most batches are one run, of which the two ends tell.
    if n and split(0) == split(n - 1):
        yield split(0), 0, n
        return
    path, start = batch.column("path").to_pylist(), batch.column("start").to_pylist()
    a = 0
    while a < n:
        b = n if (path[-1], start[-1]) == (path[a], start[a]) else next(k for k in range(a, n) if (path[k], start[k]) != (path[a], start[a]))
        yield (path[a], start[a]), a, b
        a = b


def _ends(keys: list[str]):
    """For each split: its number of lines, and the first and the last three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, first, last, own = None, 0, [], [], []
        names = [*keys, "path", "start", "lines", "first", "last"]

        def done() -> pa.RecordBatch:
            rest = [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([lines], pa.int64()), *(pa.array([x], pa.list_(pa.string())) for x in (first, last))]
            return pa.RecordBatch.from_arrays([*own, *rest], names=names)

        for batch in batches:
            value = batch.column("value")
            for split, a, b in _runs(batch):
                if split != now:
                    if now:
                        yield done()
                    now, lines, first, last = split, 0, [], []
                    own = [batch.column(k).slice(a, 1) for k in keys]
                if len(first) < 3:
                    first = (first + value.slice(a, min(3, b - a)).to_pylist())[:3]
                last = (last + value.slice(max(a, b - 3), min(3, b - a)).to_pylist())[-3:]
                lines += b - a
        if now:
            yield done()

    return run


def _records(keys: list[str]):
    """Records that lie in one split; ``before`` is the number of lines of the file before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, carry = None, 0, None
        for batch in batches:
            for split, a, b in _runs(batch):
                value = batch.column("value").slice(a, b - a)
                if split != now:
                    now, at, carry = split, batch.column("before")[a].as_py(), None
                    skip = -at % 4  # lines of a record that began before
                if skip:
                    gone = min(skip, len(value))
                    value, skip, at = value.slice(gone), skip - gone, at + gone
                if carry is not None and len(carry):
                    value = pa.concat_arrays([carry, value])
                n = len(value) // 4
                carry = value.slice(4 * n)
                if n:
                    each = [value.take(pa.array(range(k, 4 * n, 4), pa.int64())) for k in range(4)]
                    own = [pa.concat_arrays([batch.column(k).slice(a, 1)] * n) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([split[0]] * n, pa.string()), pa.array(range(at // 4, at // 4 + n), pa.int64()), *each], names=[*keys, "path", "record_no", *PARTS])
                    at += 4 * n

    return run


def read_folder(spark: SparkSession, paths: str | list[str], keys: list[str] | None = None) -> DataFrame:
    """(path, keys, record_no, header, seq, plus, qual) of files or folders of files, numbered from 0 within each file.

    ``keys`` are columns that folder names hold, as ``write`` makes them.
    Blank lines at the end of a file are of no account; a file of another number
    of lines than a multiple of four, or a record without ``@``, is an error.
    """
    text, value = spark.read.text(paths), F.rtrim("value", F.lit("\r")).alias("value")
    named = {f"_key{i}": k for i, k in enumerate(keys or [])}
    # Keys go by names of their own until the end, so they clash with no helper column; without any file no folder names them.
    held = text.select("*", *[(col(k) if k in text.columns or text.inputFiles() else F.lit(None).cast("string")).alias(i) for i, k in named.items()])
    keys = list(named)
    own = [f"{i} {held.schema[i].dataType.simpleString()}" for i in keys]
    if names := _unsplit(text, spark, paths):
        lines = held.select(*keys, F.xxhash64("_metadata.file_path").alias("file"), value)
        found = lines.mapInArrow(_whole(keys), ", ".join([*own, "file long, record_no long", *(f"{c} string" for c in PARTS), "n long"]))
        return _checked(found.join(F.broadcast(names), "file"), named)
    lines = held.select(*keys, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), value)
    ends = materialize(lines.mapInArrow(_ends(keys), ", ".join([*own, "path string, start long, lines long, first array<string>, last array<string>"])))
    before = F.coalesce(F.sum("lines").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(ends.select("path", "start", before.alias("before")))
    split = F.xxhash64("path", "start")
    small = counts.select(split.alias("split"), "before")
    known = lines.withColumn("split", split).join(F.broadcast(small) if small.count() <= SPLITS else small, "split").drop("split")
    inner = known.mapInArrow(_records(keys), ", ".join([*own, "path string, record_no long", *(f"{c} string" for c in PARTS)])).withColumn("n", F.lit(4).cast("long"))

    # The lines of records that are not whole in one split.
    rows = ends.join(counts, ["path", "start"])
    place = lambda x, i, shift: F.struct((shift + i).alias("i"), x.alias("value"))
    few = F.array_distinct(F.concat(F.transform("first", lambda x, i: place(x, i, F.lit(0).cast("long"))), F.transform("last", lambda x, i: place(x, i, F.col("lines") - F.size("last")))))
    few = rows.select(*keys, "path", "before", "lines", F.explode(few).alias("x")).withColumn("line", F.col("before") + F.col("x.i")).withColumn("record_no", F.floor(F.col("line") / 4))
    few = few.filter((F.col("record_no") * 4 < F.col("before")) | (F.col("record_no") * 4 + 3 >= F.col("before") + F.col("lines")))
    crossing = few.groupBy(*keys, "path", "record_no").agg(*[F.max(F.when(F.col("line") % 4 == k, F.col("x.value"))).alias(c) for k, c in enumerate(PARTS)], F.count(F.lit(1)).alias("n"))

    return _checked(inner.unionByName(crossing), named)


def _unsplit(text: DataFrame, spark: SparkSession, paths: str | list[str]) -> DataFrame | None:
    """(file, path) of files that are all gzip, so one split each, which takes one pass; else none.

    A file goes by the hash of its path, which is far shorter than the path in
    every line; if two paths had the same one, the way by splits is taken.
    """
    files = text.inputFiles()
    if not files or len(files) > SPLITS or not all(f.endswith(".gz") for f in files):
        return None
    path = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path")).distinct()
    names = materialize(path.select(F.xxhash64("path").alias("file"), "path"))
    return None if names.select("file").distinct().count() < names.count() else names


def _checked(all_: DataFrame, named: dict[str, str]) -> DataFrame:
    """Records that are whole, with the keys' own names; blank lines at the end of a file go, others are an error."""
    blank = (F.col("n") < 4) & (F.concat_ws("", *PARTS) == "")
    whole = (F.col("n") == 4) & F.col("header").startswith("@")
    checked = F.when(whole, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("a record is not complete in "), F.col("path"))).cast("string"))
    return all_.filter(~blank).select("path", *[F.col(i).alias(k) for i, k in named.items()], "record_no", checked.alias("header"), "seq", "plus", "qual")


def _uri(path: str) -> str:
    """A path without doubled slashes after its scheme, which Spark writes in two ways."""
    return re.sub(r"^([A-Za-z][\w+.-]*):/+", r"\1:/", path)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, record_no, header, seq, plus, qual) of the files, in the order given, numbered from 0 within each."""
    number = {_uri(u): i for i, p in enumerate(paths) for u in spark.read.text(p).inputFiles()}
    rows = read_folder(spark, paths)
    uri = F.regexp_replace("path", r"^([A-Za-z][\w+.-]*):/+", "$1:/")
    # A join finds a file at once, however many there are; a map would be gone through for every record.
    numbers = spark.createDataFrame(list(number.items()), "uri string, file_no int")
    return rows.withColumn("uri", uri).join(F.broadcast(numbers), "uri").select("file_no", "record_no", *PARTS)


def read_pairs(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Records of pairs of files side by side; mates are matched by their place."""
    sides = [read(spark, [p[k] for p in pairs]).select("file_no", "record_no", *[F.col(c).alias(f"{s}_{c}") for c in PARTS]) for k, s in enumerate("fr")]
    return sides[0].join(sides[1], ["file_no", "record_no"])


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Records of one file."""
    return read_folder(spark, path).drop("path")


def record(header: Column, seq: Column, qual: Column) -> Column:
    """The four lines of a record."""
    return F.concat_ws("\n", header, seq, F.lit("+"), qual)


def write(reads: DataFrame, path: str, keys: list[str] | None = None, compress: bool = False, header: str = "header", seq: str = "seq", qual: str = "qual") -> None:
    """Records as FASTQ files in a folder, or in a folder for each value of ``keys``.

    No shuffle: every task writes its own files.  ``compress`` makes them gzip.
    """
    keys = keys or []
    rows = reads.select(record(F.col(header), F.col(seq), F.col(qual)).alias("value"), *keys)
    out = rows.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    (out.partitionBy(*keys) if keys else out).text(path)
