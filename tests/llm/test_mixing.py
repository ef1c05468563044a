import random
import re
from collections import defaultdict

from locuspark.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def table(spark, n=200):
    rng = random.Random(3)
    names = ["b", "a", "é", "Z", None]
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)) + rng.choice(["", "\n", " x"]), names[0] if i % 3 == 0 else rng.choice(names), "clash") for i in range(n)]
    rows += [(n, None, "a", "x"), (n + 1, "", "only-empty", "x"), (n + 2, "one", "small", "x"), (5, rows[5][1], rows[5][2], "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def expected_targets(sizes, epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rate = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * rate >= epochs * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * rate) for s in names}
        fixed |= {s: epochs * sizes[s] for s in over}


def test_targets_and_budgets(spark):
    df, rows = table(spark)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = expected_targets(dict(sizes))
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        whole = min(3, int(want[r["source"]] // max(1, sizes[r["source"]]))) if sizes[r["source"]] else 0
        assert r["taken"] >= (whole - 1) * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df.repartition(3)).collect()))


def test_whole_documents_come_within_half_of_one(spark):
    df, rows = table(spark)
    got = M.mix(df, cut=False).collect()
    largest, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in taken)
    copies = M.repeated(df.limit(10**6))
    assert copies.columns == df.columns


def test_keys_prefer_quality(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s", 1.0 if i % 2 else 0.1) for i in range(600)], "doc_id long, text string, source string, q double")
    from pyspark.sql import functions as F

    half = M.mix(df.withColumn("source", F.lit("s")), quality_weight=F.col("q"), weight_of=lambda p: F.lit(1.0)).select("doc_id", "taken")
    assert half.count() == 600
    key = df.select("q", M.exponential_key(1, F.col("text"), F.col("q"), F.col("doc_id")).alias("k")).orderBy("k").limit(200).collect()
    assert sum(r["q"] == 1.0 for r in key) > 150


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_which_documents_are_taken_equals_brute_force(spark):
    from pyspark.sql import functions as F

    df, rows = table(spark, 120)
    keyed = df.select("doc_id", "source", M.word_count(F.col("text")).alias("size_"), M.exponential_key(7, F.coalesce("text", F.lit("")), M.quality(F.coalesce("text", F.lit(""))), F.col("doc_id")).alias("key")).collect()
    sizes = defaultdict(int)
    for r in keyed:
        sizes[r["source"]] += r["size_"]
    want, targets = [], expected_targets(dict(sizes))
    for source in sizes:
        budget = int(targets[source] + 0.5)
        whole = budget // sizes[source] if sizes[source] else 0
        rest = budget - whole * sizes[source]
        for r in sorted((r for r in keyed if r["source"] == source), key=lambda r: (r["key"], r["doc_id"])):
            extra = max(0, min(rest, r["size_"]))
            rest -= r["size_"]
            want.append((r["doc_id"], source, r["size_"], whole * r["size_"] + extra))
    got = [(r["doc_id"], r["source"], r["size"], r["taken"]) for r in M.mix(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_keeps_columns_of_any_names(spark):
    names = ["doc_id", "text", "source", "_i", "_hash", "_copy", "hash", "id", "n", "a.b", "copy"]
    rows = [(i, "w " * (i % 7 + 1), "s" if i % 3 else None, *[f"{c}{i}" for c in names[3:]]) for i in range(40)] + [(0, "w ", None, *["again"] * 8)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{c}` string' for c in names[3:])}")
    got = M.repeated(df)
    assert got.columns == names
    out = got.collect()
    assert out and {tuple(r) for r in out} <= set(rows)
    slim = M.repeated(df.select("doc_id", "text", "source"))
    assert slim.count() == len(out)
    odd = M.repeated(df.withColumnRenamed("text", "t.t").withColumnRenamed("source", "_s"), "doc_id", "t.t", "_s")
    assert odd.count() == len(out)


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "w " * 200_000, "a"), (2, "w", "a"), (3, "w w", "b")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"]) for r in M.mix(df).collect()} == {(1, 200_000), (2, 1), (3, 2)}
