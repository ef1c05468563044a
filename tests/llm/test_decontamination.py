import random
import re

import pytest
from pyspark.sql import functions as F

from locuspark.llm import decontamination as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def tables(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "Ñandú", "ÀB", "THE"]
    text = lambda m: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "@"]) for _ in range(m))
    items = [(i, text(rng.choice([10, 11, 25, 40]))) for i in range(12)] + [(20, text(4)), (21, "The"), (22, "w1 w2"), (23, None), (24, " .,"), (None, text(14)), (0, text(12)), (25, "the the the the the the the the the the the the")]
    docs = [(i, text(rng.choice([0, 1, 9, 60, 200]))) for i in range(50)]
    for i in range(60, 100):
        item = words(rng.choice(items)[1])
        a, b = rng.randrange(len(item) + 1), rng.randrange(len(item) + 1)
        docs.append((i, text(rng.randrange(30)) + rng.choice([" ", ". ", ""]) + rng.choice([" ", "/", "\n"]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in item[min(a, b) : max(a, b) + 9]) + " " + text(rng.randrange(30))))
    docs += [(200 + i, docs[55][1]) for i in range(30)] + [(300, None), (301, ""), (302, "the " * 20_000), (60, docs[60][1]), (60, docs[60][1]), (None, items[1][1])]
    return docs, items


def got(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, same string, n_hit int").repartition(3)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, words int")
    rows = D.contamination(d, b, **more).collect()
    for r in rows:
        cover = {p for h in r["hits"] for p in range(h["start"], h["start"] + h["length"])}
        assert len(cover) == r["n_hit"] and [tuple(h) for h in r["hits"]] == sorted(map(tuple, r["hits"]))
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows], key=str)


def test_equals_brute_force(spark):
    docs, items = tables()
    assert got(spark, docs, items) == brute(docs, items)


def test_blocks_of_keys_change_nothing(spark):
    docs, items = tables(9)
    assert got(spark, docs, items, block=50) == brute(docs, items)


def test_windows_of_ten_alone(spark):
    rng = random.Random(2)
    item = [f"v{i}" for i in range(30)]
    docs = [(i, " ".join([f"u{rng.randrange(99)}" for _ in range(i)] + item[i : i + 8 + i % 3])) for i in range(20)]
    assert got(spark, docs, [(5, " ".join(item))]) == brute(docs, [(5, " ".join(item))])


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    docs, items = ([] if empty == "docs" else [(1, "a b"), (2, None)]), ([] if empty == "items" else [(1, "a")])
    assert got(spark, docs, items) == brute(docs, items)


def test_odd_names_and_ids(spark):
    d = spark.createDataFrame([("x", "one two"), (None, "two")], "n_words string, `t.t` string")
    out = D.contamination(d, d, "n_words", "t.t", "n_words", "t.t")
    assert out.columns == ["n_words", "n_words_", "n_hit", "hits", "items"]
    assert {(r[0], r[1], r[2], tuple(r[4])) for r in out.collect()} == {("x", 2, 2, ("", "x")), (None, 1, 1, ("",))}


def test_native_plan(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = D.contamination(d, d.withColumnRenamed("doc_id", "item_id")).groupBy().agg(F.count(F.lit(1)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
