import gzip
from pathlib import Path

import pytest

from locuspark.operators.demux import Demux
from locuspark.sources import fastq, tables
from locuspark.streaming import reads as streams

RECORDS = "@a 1\nACGT\n+\nIIII\n@b 2\nTTTT\n+x\n!!!!\n"


def test_fastq_plain_gzip_and_pairs(spark, tmp_path):
    (tmp_path / "a.fq").write_text(RECORDS)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(RECORDS)
    a, b = str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz")
    rows = sorted(map(tuple, fastq.read(spark, [a, b]).collect()))
    assert rows[1] == (0, 1, "@b 2", "TTTT", "+x", "!!!!") and len(rows) == 4
    both = fastq.read_pairs(spark, [(a, b)]).orderBy("record_no").collect()
    assert [(r["f_seq"], r["r_seq"]) for r in both] == [("ACGT", "ACGT"), ("TTTT", "TTTT")]
    plain = fastq.read_plain(spark, a).orderBy("record_no").collect()
    assert [(r["header"], r["qual"]) for r in plain] == [("@a 1", "IIII"), ("@b 2", "!!!!")]


def test_incomplete_record(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a\nACGT\n+\n")
    with pytest.raises(Exception, match="not complete"):
        fastq.read(spark, [str(tmp_path / "a.fq")]).collect()


def test_user_tables(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert sorted(map(tuple, tables.dist_table(spark, put("d", "32 3 4\nbad\n41\t5 6\n")).collect())) == [(32, 3, 4), (41, 5, 6)]
    assert tuple(tables.dist_table(spark, None).first()) == (1, 4, 6)
    assert tables.ind_infiles(spark, put("i", "x\ta.fq\ny\tb.fq\n")).count() == 2
    with pytest.raises(ValueError):
        tables.ind_infiles(spark, put("j", "x\ta.fq\nx\tb.fq\n"))
    with pytest.raises(ValueError):
        tables.ind_infiles(spark, put("k", "x\ta.fq\n"), spark.createDataFrame([("x",)], "ind string"))
    assert tables.settings("a 1 # one\nb\n# c\n", {"a", "b"}) == {"a": "1", "b": ""}
    with pytest.raises(ValueError):
        tables.settings("z 1", {"a"})
    assert tables.sl_ranges(spark, put("r", "32\t79\n80\t140\n")) == [(32, 79), (80, 140)]
    assert tables.barcode_adapters(spark, put("b", "ACGT AR\n")) == {"ACGT": ["AA", "AG"]}
    assert tables.file_pairs(spark, put("p", "a b\n")) == [("a", "b")]
    uc = "H\t0\t32\t95\t+\t0\t0\tx\tL2\tL1\nC\t0\t2\t*\t*\t*\t*\t*\tL1\t*\nS\t0\t1\t*\t*\t*\t*\t*\tL1\t*\n"
    assert sorted((r["cluster"], r["label"]) for r in tables.cluster_records(spark, put("u", uc)).collect()) == [(0, "L1"), (0, "L2")]
    inds = spark.createDataFrame([("x",), ("y",)], "ind string")
    assert tables.user_groups(spark, put("g", "x\t1\ny\t2\n"), inds).count() == 2
    with pytest.raises(ValueError):
        tables.user_groups(spark, put("h", "x\t1\n"), inds)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "GATCAA", "IIIIII"), (1, "GATCAA", "IIIIII"), (2, "TTTTTT", "IIIIII")], "ind long, seq string, qual string")
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.count_svars(live, "counts", str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r["ind"], r["depth"]) for r in spark.table("counts").collect()) == [(1, 2), (2, 1)]
    q = streams.demultiplex(live, Demux(sites=("GATC",)), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert {r["dest"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("dest").count().collect()} == {"SAMP": 2, "NN": 1}


def test_fastq_written_by_destination_and_split_files(spark, tmp_path):
    rows = [(f"@r{i} x", "ACGT"[i % 4] * 5, "I@+!#"[i % 5] * 5, f"d{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "header string, seq string, qual string, dest string").repartition(3)
    for compress in (False, True):
        path = str(tmp_path / f"out{compress}")
        fastq.write(df, path, ["dest"], compress)
        back = fastq.read_folder(spark, path, ["dest"])
        assert sorted((r["header"], r["seq"], r["qual"], r["dest"]) for r in back.collect()) == sorted(rows)
    text = "".join(f"@n{i}\n{'ACGT' * (i % 9 + 1)}\n+\n{'@III' * (i % 9 + 1)}\n" for i in range(3000))
    (tmp_path / "big.fq").write_text(text + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = fastq.read(spark, [str(tmp_path / "big.fq")]).orderBy("record_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["header"] for r in got] == [f"@n{i}" for i in range(3000)] and got[8]["qual"] == "@III" * 9


def test_fastq_data_source(spark, tmp_path):
    (tmp_path / "a.fq").write_text(RECORDS + "\n")
    (tmp_path / "b.fq").write_text(RECORDS + "@lone\n")
    fastq.register(spark)
    load = lambda name: spark.read.format("fastq").option("path", str(tmp_path / name)).load()
    assert [tuple(r) for r in load("a.fq").orderBy("record_no").collect()][1] == (0, 1, "@b 2", "TTTT", "+x", "!!!!")
    for read in (load, lambda name: fastq.read(spark, [str(tmp_path / name)])):
        with pytest.raises(Exception, match="not complete"):
            read("b.fq").collect()


def test_settings_and_group_columns(spark, tmp_path):
    assert tables.settings("a\tx y # z\n  b   1\nc\n\n# d", {"a", "b", "c"}) == {"a": "x y", "b": "1", "c": ""}
    (tmp_path / "g").write_text("1\tnorth\t3\t5\n2\tsouth\t4\t6\n")
    inds = spark.createDataFrame([(1,), (2,)], "ind long")
    assert sorted(map(tuple, tables.user_groups(spark, str(tmp_path / "g"), inds).collect())) == [(1, "north"), (2, "south")]
    assert sorted(map(tuple, tables.user_groups(spark, str(tmp_path / "g"), inds, 2).collect())) == [(1, "3"), (2, "4")]
    assert sorted(map(tuple, tables.user_groups(spark, str(tmp_path / "g"), inds, more=["pop", "x", "y"]).collect())) == [(1, "north", "3", "5"), (2, "south", "4", "6")]


def test_simulated_loci_are_apart_from_all_others():
    import random

    from locuspark.operators import simulate

    s = simulate.Settings(loci=40, length=40, least_distance=18)
    loci = simulate.sim_loci(s, random.Random(1))
    assert len(loci) == 40 and all(sum(a != b for a, b in zip(x, y, strict=True)) >= 18 for i, x in enumerate(loci) for y in loci[:i])
    with pytest.raises(ValueError, match="loci that are"):
        simulate.sim_loci(simulate.Settings(loci=40, length=20, least_distance=20), random.Random(1))


@pytest.mark.parametrize("split", ["60", "333", "100000"])
def test_records_across_splits_of_any_size(spark, tmp_path, split):
    lines = [x for i in range(10) for x in (f"@r{i}", "ACGT" * (i % 9 + 1), "+", "@" * (4 * (i % 9 + 1)))]
    (tmp_path / "a.fq").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "b.fq").write_text("\r\n".join(lines[:16]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = fastq.read(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")])
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(f, i, *lines[4 * i : 4 * i + 4]) for f, n in ((0, 10), (1, 4)) for i in range(n)]
    # The lines meet no exchange: what is exchanged is read from the short tables of the first pass.
    for part in plan.split("Union")[1:]:
        scan = part.split("MapInArrow")
        assert len(scan) == 2 and "Exchange" not in scan[1].split("BroadcastExchange")[0]


def test_broken_records_are_errors(spark, tmp_path):
    for k, text in enumerate(("@a\nAC\n+\n", "@a\nAC\n+\nII\nb\nAC\n+\nII\n")):
        (tmp_path / f"{k}.fq").write_text(text)
        with pytest.raises(Exception, match="not complete"):
            fastq.read(spark, [str(tmp_path / f"{k}.fq")]).collect()


def test_splits_grow_with_the_files(spark, tmp_path):
    from locuspark.queries import files
    from locuspark.queries.fixtures import Fixture

    f = Fixture.__new__(Fixture)
    f.spark = spark
    paths = [str(tmp_path / n) for n in "ab"]
    for p, n in zip(paths, (30, 70), strict=True):
        with open(p, "w") as out:
            out.truncate(n * files.SPLIT_BYTES)
    assert files._split_bytes(f, paths) == files.SPLIT_BYTES
    for p in paths:
        with open(p, "w") as out:
            out.truncate(3 * files.SPLITS * files.SPLIT_BYTES)
    assert files._split_bytes(f, paths) == 6 * files.SPLIT_BYTES


def test_number_of_a_file_is_joined(spark, tmp_path):
    paths = [str(tmp_path / f"{i}.fq") for i in range(30)]
    for i, p in enumerate(paths):
        Path(p).write_text(f"@r{i}\nACGT\n+\nIIII\n")
    got = fastq.read(spark, paths[::-1])
    assert sorted((r["file_no"], r["header"]) for r in got.collect()) == [(29 - i, f"@r{i}") for i in reversed(range(30))]
    assert "29.fq" not in got._jdf.queryExecution().optimizedPlan().toString().replace("FileIndex", "")


def test_gzip_files_take_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fastq, "_ends", lambda keys: pytest.fail("lines are counted beforehand"))
    want = []
    for dest, n in (("a", 3), ("a", 0), ("b", 7001), ("c d", 1)):
        folder = tmp_path / "in" / f"dest={dest}"
        folder.mkdir(parents=True, exist_ok=True)
        rows = [(f"@{dest}{i}", "ACGT", "+", "IIII") for i in range(n)]
        with gzip.open(folder / f"{n}.gz", "wt", newline="") as f:
            f.write("".join("\r\n".join(r) + "\r\n" for r in rows) + ("\n\n" if n == 3 else ""))
        want += [(dest, i, *r) for i, r in enumerate(rows)]
    got = fastq.read_folder(spark, str(tmp_path / "in"), ["dest"])
    assert sorted(tuple(r) for r in got.select("dest", "record_no", "header", "seq", "plus", "qual").collect()) == sorted(want)
    assert got.select("path").distinct().count() == 3 and got.filter("path like 'file:/%.gz'").count() == len(want)
    with gzip.open(tmp_path / "in" / "dest=a" / "bad.gz", "wt") as f:
        f.write("@x\nACGT\n+\n")
    with pytest.raises(Exception, match="not complete"):
        fastq.read_folder(spark, str(tmp_path / "in"), ["dest"]).collect()


@pytest.mark.parametrize("compress", [False, True])
def test_keys_named_as_helper_columns(spark, tmp_path, compress):
    keys = ["file", "n", "start", "lines", "split"]
    rows = [(f"@r{i}", "ACGT", "IIII", i % 2, "x", i % 3, "y", i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "header string, seq string, qual string, file int, n string, start int, lines string, split int")
    fastq.write(df.repartition(3), str(tmp_path / "out"), keys, compress)
    back = fastq.read_folder(spark, str(tmp_path / "out"), keys)
    assert back.columns == ["path", *keys, "record_no", *fastq.PARTS]
    assert sorted(tuple(r) for r in back.select("header", "seq", "qual", *keys).collect()) == sorted(rows)
    fastq.write(df.limit(0), str(tmp_path / "none"), keys, compress)
    assert fastq.read_folder(spark, str(tmp_path / "none"), keys).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 3, 1, 7), (6, 5, 2, 9), (2, 4, 1, 8), (2, 9, 3, 11), (4, 1, 1, 1)], [(s, o, i, 3) for s in range(9) for o in range(1, 30) for i in (1, 2)]])
def test_filtered_reads_are_written_and_reported(spark, tmp_path, rows):
    duckdb = pytest.importorskip("duckdb")
    from __spark_entry__ import oracle_sql, queries

    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    found = db.execute(oracle_sql()["phred_filter_written"])
    names = [c[0] for c in found.description]
    got = queries()["phred_filter_written"](spark, str(tmp_path))
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(found.fetchall())
