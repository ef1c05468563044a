import random

import pytest
from pyspark.sql import functions as F

from locuspark.operators import similarity as M
from locuspark.functions import sequence as S


def dist(a, b, ignore_n=True):
    return sum(x != y and not (ignore_n and "N" in (x, y)) for x, y in zip(a, b, strict=True))


def table(rng, n, start=""):
    base = ["".join(rng.choice("ACGT") for _ in range(20 - len(start))) for _ in range(6)]
    out = set()
    while len(out) < n:
        s = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        out.add((start if rng.random() < 0.8 else "C" * len(start)) + "".join(s))
    return sorted(out)


@pytest.mark.parametrize("heavy", [2, 5, 2000])
@pytest.mark.parametrize("ignore_n", [True, False])
def test_pairs_are_whole_with_heavy_fragments(spark, monkeypatch, heavy, ignore_n):
    monkeypatch.setattr(M, "HEAVY", heavy)
    rng = random.Random(heavy)
    rows = [(g, s) for g in (1, 2) for s in table(rng, 60, "GATCCA")] + [(1, "NNNNNNNNNNNNNNNNNNNN"), (1, "AC"), (1, "AG")]
    df = spark.createDataFrame(rows * 2, "g long, seq string")
    got = {(r["g"], r["seq1"], r["seq2"], r["dist"]) for r in M.similar_pairs(df, ["g"], "seq", 3, ignore_n).collect()}
    want = {(g, a, b, dist(a, b, ignore_n)) for g, a in rows for h, b in rows if g == h and a < b and len(a) == len(b) and dist(a, b, ignore_n) <= 3}
    assert got == want
    rare = [(1, s) for s in table(rng, 25, "GATCCA")]
    got = {(r["seq1"], r["seq2"], r["dist"]) for r in M.similar_between(spark.createDataFrame(rare, "g long, s string"), df, ["g"], "s", "seq", 3, ignore_n).collect()}
    assert got == {(a, b, dist(a, b, ignore_n)) for _, a in rare for g, b in rows if g == 1 and len(a) == len(b) and dist(a, b, ignore_n) <= 3}


def test_one_fragment_in_half_of_all_svars_fills_no_task(spark, monkeypatch):
    monkeypatch.setattr(M, "HEAVY", 50)
    rng = random.Random(1)
    seqs = {("GATCCA" if i % 2 else "".join(rng.choice("ACGT") for _ in range(6))) + "".join(rng.choice("ACGT") for _ in range(26)) for i in range(20_000)}
    rows = spark.createDataFrame([(1, s, len(s), 4) for s in seqs], "g long, seq string, sl int, d int").withColumn("planes", S.planes(F.col("seq")))
    rows = rows.cache()
    for left, _ in M.dealt(rows, rows, ["g"], True):
        sizes = left.groupBy("g", "sl", "k", "piece", "block", "meets").count()
        assert sizes.agg(F.max("count")).first()[0] <= 2 * M.HEAVY
        each = left.groupBy(F.pmod(F.xxhash64("g", "sl", "k", "piece", "block", "meets"), F.lit(8)).alias("task")).count().toPandas()["count"]
        assert each.max() <= 2 * each.median()
    rows.unpersist()


def test_small_groups_need_no_count_of_keys(spark, monkeypatch):
    monkeypatch.setattr(M, "heavy_keys", lambda *a: pytest.fail("keys of small groups are counted"))
    rng = random.Random(3)
    rows = [(g, s) for g in (1, 2) for s in table(rng, 30)] + [(1, "ACGT" * 24 + "ACGN"), (1, "ACGT" * 25)]
    df = spark.createDataFrame(rows, "g long, seq string")
    found = M.similar_pairs(df, ["g"], "seq", 3, True)
    # The distance is spelled out, so the join is compiled with it.
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["g"], r["seq1"], r["seq2"], r["dist"]) for r in found.collect()} == {(g, a, b, dist(a, b)) for g, a in rows for h, b in rows if g == h and a < b and len(a) == len(b) and dist(a, b) <= 3}


@pytest.mark.parametrize("ignore_n", [True, False])
def test_small_groups_are_not_cut_and_large_ones_are(spark, monkeypatch, ignore_n):
    monkeypatch.setattr(M, "HEAVY", 100)
    cut, real = [], M.dealt
    monkeypatch.setattr(M, "dealt", lambda left, *more: cut.extend(r["g"] for r in left.select("g").distinct().collect()) or real(left, *more))
    rng = random.Random(7)
    rows = [(g, s) for g, n in ((1, 5), (2, 4), (3, 60), (4, 1)) for s in table(rng, n)] + [(1, "ACGT" * 24 + "ACGN"), (1, "ACGT" * 25), (2, "N" * 20)]
    df = spark.createDataFrame(rows, "g long, seq string").withColumn("own", F.col("g") + F.length("seq"))
    near = lambda a, b: len(a) == len(b) and dist(a, b, ignore_n) <= 3
    got = [(r["g"], r["seq1"], r["seq2"], r["dist"]) for r in M.similar_pairs(df, ["g"], "seq", 3, ignore_n).collect()]
    assert sorted(got) == sorted({(g, a, b, dist(a, b, ignore_n)) for g, a in rows for h, b in rows if g == h and a < b and near(a, b)})
    other = [(g, s) for g, n in ((1, 3), (3, 30), (5, 2)) for s in table(random.Random(7), n)]
    for d in (3, F.lit(3)):
        found = M.similar_between(spark.createDataFrame(other, "g long, s string"), df, ["g"], "s", "seq", d, ignore_n, carry=["own"]).collect()
        assert sorted((r["g"], r["seq1"], r["seq2"], r["dist"], r["own"]) for r in found) == sorted({(g, a, b, dist(a, b, ignore_n), g + len(b)) for g, a in other for h, b in rows if g == h and near(a, b)})
    assert set(cut) == {3}


def test_pairs_are_sorted_without_arrays(spark):
    df = spark.createDataFrame([(1, "ACGT" * 10), (1, "ACGT" * 9 + "ACGA"), (2, "ACGT")], "g long, seq string")
    found = M.similar_pairs(df, ["g"], "seq", 2, True)
    assert [tuple(r) for r in found.collect()] == [(1, 40, "ACGT" * 9 + "ACGA", "ACGT" * 10, 1)]
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and "p1_1" in joins[0] and "planes" not in joins[0]
