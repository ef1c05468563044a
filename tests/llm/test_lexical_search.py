import math
import random
import re

import pytest

from locuspark.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def brute(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in queries.items():
        weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in set(t) for _, t in held) + 1))) for w in words}
        scores = []
        for i, t in held:
            m = 100 - 90 + (90 * len(t) * n) // total
            s = sum(weight[w] * ((1_000_000_000 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in words if w in t)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def tables(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "Ñandú", "x1y", "ab-cd", "THE", "the"]
    text = lambda m: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".\n", "'s"]) for _ in range(m))
    docs = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(n)]
    docs += [(n + i, docs[3 + i % 2][1]) for i in range(30)] + [(500, None), (501, ""), (502, " .,\t"), (503, "the " * 30_000), (7, docs[7][1])]
    items = [(i, text(rng.choice([1, 3, 12, 60]))) for i in range(25)] + [(30, None), (31, "..."), (None, "the w1"), (2, "w5 w6")]
    return docs, items


def got(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, rank string, n int").repartition(3)
    q = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, score int")
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in L.search(d, q, **more).collect()], key=str)


def test_equals_brute_force(spark):
    docs, items = tables()
    assert got(spark, docs, items) == brute(docs, items)


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    docs, items = tables(5, 60)
    monkeypatch.setattr(L, "PAIRS", 60)
    monkeypatch.setattr(L, "QUERIES", 6)
    assert got(spark, docs, items, k=3) == brute(docs, items, 3)


def test_upper_bounds_hold_and_ties_go_by_id(spark):
    docs = [(i, "alpha beta") for i in range(40, 0, -1)] + [(100, "alpha"), (101, "gamma")]
    found = got(spark, docs, [(1, "alpha beta")])
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == list(range(1, 11)) and found == brute(docs, [(1, "alpha beta")])


def test_string_ids_and_odd_names(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one")], "`a.b` string, rank string")
    q = spark.createDataFrame([("q", "one")], "score string, t string")
    out = L.search(d, q, "a.b", "rank", "score", "t")
    assert out.columns == ["score", "rank", "a.b", "score_"]
    assert [tuple(r)[:3] for r in out.orderBy("rank").collect()] == [("q", 1, None), ("q", 2, "a"), ("q", 3, "b")]


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    docs, items = ([] if empty == "docs" else [(1, "a b")]), ([] if empty == "items" else [(1, "a")])
    assert got(spark, docs, items) == []
