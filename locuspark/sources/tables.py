"""User tables: file lists, settings, distances, filters, barcodes, selections, groups."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.functions.sequence import iupac_expand
from locuspark.operators.selection import Selection


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line != ''")


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Lines of n fields, parted by blanks or tabs; other lines are an error."""
    rows = _lines(spark, path).select("line", F.split("line", r"\s+").alias("x"))
    checked = F.when(F.size("x") == n, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("unexpected line: "), F.col("line"))).cast("array<string>"))
    return rows.select(checked.alias("x"))


def file_list(spark: SparkSession, path: str) -> list[str]:
    """One path a line."""
    return [r[0] for r in _lines(spark, path).collect()]


def file_pairs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Two paths a line."""
    return [tuple(r[0]) for r in _fields(spark, path, 2).collect()]


def ind_infiles(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(ind, file); individuals and files must be unique and individuals new."""
    rows = _fields(spark, path, 2).select(F.col("x")[0].alias("ind"), F.col("x")[1].alias("file"))
    for column in ("ind", "file"):
        again = [r[0] for r in rows.groupBy(column).count().filter("count > 1").select(column).take(5)]
        if again:
            raise ValueError(f"{column} given more than once: {again}")
    if known is not None and (old := [r[0] for r in rows.join(known, "ind", "left_semi").select("ind").take(5)]):
        raise ValueError(f"already in the database: {old}")
    return rows


def settings(text: str, known: set[str]) -> dict[str, str]:
    """``key value # comment`` lines; a key without a value has an empty one."""
    out = {}
    for line in text.splitlines():
        key, value = (*line.partition("#")[0].split(maxsplit=1), "", "")[:2]
        if key and key not in known:
            raise ValueError(f"unknown setting: {key}")
        if key:
            out[key] = value.strip()
    return out


def settings_rows(settings: object) -> list[tuple[str, str]]:
    """The fields of a settings dataclass, for a manifest that replays a run."""
    return [(f.name, str(getattr(settings, f.name))) for f in fields(settings)]


def dist_table(spark: SparkSession, path: str | None, columns: tuple[str, ...] = ("sl", "hapdist", "rarehapdist"), default: tuple[int, ...] = (1, 4, 6)) -> DataFrame:
    """Whole numbers a line; lines of another form are left out, no file gives the default."""
    schema = ", ".join(f"{c} int" for c in columns)
    if path is None:
        return spark.createDataFrame([default], schema)
    x = F.split("line", r"\s+")
    good = _lines(spark, path).filter(F.col("line").rlike(r"^\d+" + r"\s+\d+" * (len(columns) - 1) + "$"))
    return good.select(*[x[i].cast("int").alias(c) for i, c in enumerate(columns)])


def filter_positions(spark: SparkSession, path: str) -> DataFrame:
    """(strand f or r, pos from 1, min_score)."""
    x = F.col("x")
    return _fields(spark, path, 3).select(x[0].alias("strand"), x[1].cast("int").alias("pos"), x[2].cast("int").alias("min_score"))


def barcodes(spark: SparkSession, path: str) -> list[str]:
    return file_list(spark, path)


def barcode_adapters(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The plain adapters of each barcode."""
    return {r[0][0]: iupac_expand(r[0][1]) for r in _fields(spark, path, 2).collect()}


def sl_ranges(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    out = [(int(a), int(b)) for (a, b) in (r[0] for r in _fields(spark, path, 2).collect())]
    if any(a > b for a, b in out):
        raise ValueError("a range begins after its end")
    return out


def selection(spark: SparkSession, loci_links: DataFrame, ind: str | None = None, loc: str | None = None, gt: str | None = None) -> Selection:
    """What was genotyped, narrowed by any of three files of keys."""
    x = F.col("x")
    sel = Selection.default(loci_links)
    return sel.restrict(
        ind=None if ind is None else _fields(spark, ind, 1).select(x[0].cast(loci_links.schema["ind"].dataType).alias("ind")),
        loc=None if loc is None else _fields(spark, loc, 1).select(x[0].cast("long").alias("poploc")),
        gt=None if gt is None else _fields(spark, gt, 2).select(x[0].cast("long").alias("poploc"), x[1].cast(loci_links.schema["ind"].dataType).alias("ind")),
    )


def user_groups(spark: SparkSession, path: str, inds: DataFrame, column: int = 1, more: list[str] | None = None) -> DataFrame:
    """(ind, grp) of the column of that number, from 0; the individuals must be those of ``inds``.

    ``more`` names the columns after the first that are wanted instead of grp, in order.
    """
    x = F.split("line", "\t")
    wanted = [(column, "grp")] if more is None else list(enumerate(more, 1))
    rows = _lines(spark, path).select(x[0].cast(inds.schema["ind"].dataType).alias("ind"), *[F.get(x, F.lit(i)).alias(c) for i, c in wanted])
    for a, b, what in ((inds, rows, "have no group"), (rows, inds, "are not selected")):
        if missing := [r[0] for r in a.join(b, "ind", "left_anti").select("ind").take(5)]:
            raise ValueError(f"individuals {missing} {what}")
    return rows


def cluster_records(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, label, kind, size) of hit and cluster lines of a tab-separated clustering record."""
    x = F.split("value", "\t")
    return spark.read.text(path).filter(x[0].isin("H", "C")).select(x[1].cast("long").alias("cluster"), x[8].alias("label"), x[0].alias("kind"), x[2].cast("long").alias("size"))
