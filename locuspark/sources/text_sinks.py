"""Text formats of population genetics and phylogenetics.

Each function gives a DataFrame (line_no, line) in the order of the file;
``write_lines`` writes it as one text file, or as parts in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.operators.export import dense
from locuspark.plans.ordering import numbered, ranked


def write_lines(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """Lines in order, as parts by range of the number; as one file they go through one task."""
    ordered = lines.orderBy("line_no") if not one_file else lines.repartition(1).sortWithinPartitions("line_no")
    ordered.select("line").write.mode("overwrite").text(path)


def _lines(*parts: tuple[DataFrame, list[Column]]) -> DataFrame:
    """Parts (rows with ``line``, their order) one after the other, numbered by ranges of their order."""
    keyed = [(i, df.select("line", *[o.alias(f"_o{k}") for k, o in enumerate(order)]), len(order)) for i, (df, order) in enumerate(parts)]
    each = [numbered(df, [F.col(f"_o{k}") for k in range(n)], "n").select((F.lit(i) * F.lit(1 << 40) + F.col("n") + 1).alias("line_no"), "line") for i, df, n in keyed]
    return reduce(DataFrame.unionByName, each)


def _text(df: DataFrame, *lines: str) -> tuple[DataFrame, list[Column]]:
    rows = df.sparkSession.createDataFrame(list(enumerate(lines)), "i int, line string")
    return rows, [F.col("i")]


def fasta(seqs: DataFrame, label: Column, seq: str = "seq", order: list[Column] | None = None) -> DataFrame:
    rows = seqs.select(F.concat(F.lit(">"), label, F.lit("\n"), F.col(seq)).alias("line"), *[o.alias(f"_{i}") for i, o in enumerate(order or [label])])
    return _lines((rows, [F.col(c) for c in rows.columns if c.startswith("_")]))


def write_fasta(seqs: DataFrame, label: Column, path: str, keys: list[str], order: list[Column], seq: str = "seq") -> None:
    """Sequences as FASTA, in a folder for each value of ``keys``, in order within it; a folder's rows stay in one file up to a task's share.

    Rows are dealt by ranges of keys and order, so a large folder is written by several tasks, in parts in order.
    """
    rows = seqs.select(*keys, F.concat(F.lit(">"), label, F.lit("\n"), F.col(seq)).alias("line"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    by = [*keys, *[f"_o{i}" for i in range(len(order))]]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("line", *keys).write.mode("overwrite").partitionBy(*keys).text(path)


def _counts(seqs: DataFrame, seq: str) -> tuple[int, int]:
    n, length = seqs.agg(F.count(F.lit(1)), F.max(F.length(seq))).first()
    return n, length or 0


def nexus(seqs: DataFrame, label: Column, seq: str = "seq", missing: str = "-") -> DataFrame:
    """A data block; the gap letter is N where - marks missing data."""
    n, length = _counts(seqs, seq)
    gap = "N" if missing == "-" else "-"
    rows = seqs.select(F.concat(label, F.lit(" "), F.col(seq)).alias("line"), label.alias("_k"))
    head = _text(seqs, "#NEXUS", "BEGIN DATA;", f"DIMENSIONS NTAX={n} NCHAR={length};", f"FORMAT DATATYPE=DNA MISSING={missing} GAP={gap};", "MATRIX")
    return _lines(head, (rows, [F.col("_k")]), _text(seqs, ";", "END;"))


def phylip(seqs: DataFrame, label: Column, seq: str = "seq") -> DataFrame:
    """Names padded to the longest one, 10 letters at least, and three blanks."""
    n, length = _counts(seqs, seq)
    width = max(10, seqs.agg(F.max(F.length(label))).first()[0] or 0) + 3
    rows = seqs.select(F.concat(F.rpad(label, width, " "), F.col(seq)).alias("line"), label.alias("_k"))
    return _lines(_text(seqs, f"{n} {length}"), (rows, [F.col("_k")]))


def _by_ind(diploid: DataFrame, cell: Column, sep: str, missing: str) -> DataFrame:
    """(ind, cells): cells of (poploc, ind) in locus order, the missing ones filled by place."""
    index = ranked(diploid.select("poploc").distinct(), ["poploc"], "place")
    n = index.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    placed = diploid.select("poploc", "ind", cell.alias("cell")).join(index, "poploc").groupBy("ind").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "cell"))).alias("c"))
    full = dense(F.col("c.cell"), F.col("c.place"), lambda k: F.array_repeat(F.lit(missing), k), F.lit(n).cast("int"))
    return placed.select("ind", F.array_join(full, sep).alias("cells"))


def structure(diploid: DataFrame, pre: DataFrame | None = None) -> DataFrame:
    """Two lines an individual of (poploc, ind, a1, a2); missing alleles are -9.

    ``pre`` (ind, columns) holds text that follows the name.
    """
    both = [_by_ind(diploid, F.col(a).cast("string"), "\t", "-9").withColumn("copy", F.lit(i)) for i, a in enumerate(("a1", "a2"))]
    rows = both[0].unionByName(both[1])
    rows = rows.withColumn("columns", F.lit("")) if pre is None else rows.join(pre.select("ind", F.concat(F.lit("\t"), F.col("columns")).alias("columns")), "ind", "left")
    line = F.concat(F.col("ind").cast("string"), F.coalesce("columns", F.lit("")), F.lit("\t"), F.col("cells"))
    return _lines((rows.select(line.alias("line"), "ind", "copy"), [F.col("ind"), F.col("copy")]))


def genepop(diploid: DataFrame, pops: DataFrame, title: str = "Title") -> DataFrame:
    """A title, the loci, and a block of individuals for each population (ind, pop)."""
    cell = F.concat(F.lpad(F.col("a1").cast("string"), 2, "0"), F.lpad(F.col("a2").cast("string"), 2, "0"))
    rows = _by_ind(diploid, cell, " ", "0000").join(pops.select("ind", "pop"), "ind")
    blocks = rows.select("pop", F.lit(1).alias("k"), "ind", F.concat(F.col("ind").cast("string"), F.lit(" , "), F.col("cells")).alias("line"))
    marks = rows.select("pop").distinct().select("pop", F.lit(0).alias("k"), F.lit(None).cast(rows.schema["ind"].dataType).alias("ind"), F.lit("Pop").alias("line"))
    loci = diploid.select("poploc").distinct().select(F.col("poploc").cast("string").alias("line"), "poploc")
    return _lines(_text(diploid, title), (loci, [F.col("poploc")]), (marks.unionByName(blocks), [F.col("pop"), F.col("k"), F.col("ind")]))


def arlequin(diploid: DataFrame, pops: DataFrame, title: str = "Title") -> DataFrame:
    """Profile, a sample for each population, and one group with all of them."""
    names = [r[0] for r in pops.select(F.col("pop").cast("string")).distinct().orderBy("pop").collect()]
    sides = [_by_ind(diploid, F.col(a).cast("string"), " ", "?").withColumn("k", F.lit(i)) for i, a in enumerate(("a1", "a2"))]
    rows = sides[0].unionByName(sides[1]).join(pops.select("ind", F.col("pop").cast("string").alias("pop")), "ind")
    lines = rows.select("pop", F.lit(1).alias("b"), "ind", "k", F.concat(F.when(F.col("k") == 0, F.concat(F.col("ind").cast("string"), F.lit(" 1 "))).otherwise(F.lit("    ")), F.col("cells")).alias("line"))
    ind_type = rows.schema["ind"].dataType
    heads = rows.groupBy("pop").agg((F.count(F.lit(1)) / 2).cast("int").alias("n")).select("pop", F.lit(0).alias("b"), F.lit(None).cast(ind_type).alias("ind"), F.lit(0).alias("k"), F.format_string('SampleName="%s"\nSampleSize=%d\nSampleData={', "pop", "n").alias("line"))
    tails = heads.select("pop", F.lit(2).alias("b"), "ind", "k", F.lit("}").alias("line"))
    top = _text(diploid, "[Profile]", f'Title="{title}"', f"NbSamples={len(names)}", "DataType=STANDARD", "GenotypicData=1", "GameticPhase=0", "LocusSeparator=WHITESPACE", 'MissingData="?"', "[Data]", "[[Samples]]")
    end = _text(diploid, "[[Structure]]", 'StructureName="one group"', "NbGroups=1", "Group={", *[f'"{n}"' for n in names], "}")
    return _lines(top, (heads.unionByName(lines).unionByName(tails), [F.col(c) for c in ("pop", "b", "ind", "k")]), end)
