import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuspark.llm import bloom_lm as B

SCHEMA = "doc_id long, text string, score double"


def table(spark, n=150):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["É", "The", "ÄB"]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(rng.randrange(40))), 1.0) for i in range(n)]
    rows += [(n, None, None), (n + 1, "", None), (None, "The the\tTHE", 0.0), (3, rows[3][1], 0.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def fold(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def toks(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", fold(t)), None]


def out(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


@pytest.mark.parametrize("head", [B.HEAD, 10])
def test_base_equals_brute_force(spark, head):
    df, rows = table(spark)
    model, counts = B.train(df.filter(~B.held_out(F.col("doc_id"))), head=head)
    c = Counter(w for d, t, _ in rows if not out(d) for w in toks(t))
    total, kinds = sum(c.values()), len(c)
    assert (model.total, model.types) == (total, kinds)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in B.score(df, model, counts).collect())
    want = sorted(((d is None, d or 0), len(toks(t)), sum(c[w] > 0 for w in toks(t)), round(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in toks(t)), 6)) for d, t, _ in rows)
    assert got == want


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(3)
    phrases = [" ".join(f"w{rng.randrange(60)}" for _ in range(6)) for _ in range(30)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(phrases) for _ in range(5)), 0.0) for i in range(400)], SCHEMA)
    model, counts = B.train(df.filter(~B.held_out(F.col("doc_id"))))
    held = B.score(df.filter(B.held_out(F.col("doc_id"))), model, counts).agg(F.sum("score"), F.sum("base_score")).first()
    assert 0.8 * held[1] < held[0] < 0


def test_texts_without_word_order_cost_next_to_nothing(spark):
    df, _ = table(spark, 400)
    model, counts = B.train(df.filter(~B.held_out(F.col("doc_id"))))
    held = B.score(df.filter(B.held_out(F.col("doc_id"))), model, counts).agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert held[0] > held[1] - 0.1 * held[2]


def test_filter_finds_every_level():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    keys = np.unique(keys)
    counts = rng.integers(1, 200, len(keys))
    f = B.Filter([B.filled(keys, counts, 1 << 20).tobytes()])
    got = f.levels(keys)
    assert (got >= B.level(counts)).all() and (got == B.level(counts)).mean() > 0.9
    other = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (f.levels(other) > 0).mean() < 0.06


def test_filter_keeps_its_bound():
    keys = np.arange(1, 10001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.where(np.arange(10000) % 10 == 0, 50, 1)
    assert len(B.filled(keys, counts, 12000)) <= 12000


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    model, counts = B.train(df)
    assert B.score(df, model, counts).count() == 0


def keys_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return B.tokens(raw, np.array([0, len(raw)], np.int64), 0, 1)


def test_next_tokens_sum_to_one_at_most(spark):
    df, rows = table(spark)
    model, _ = B.train(df, order=3)
    probes = B.Probes(model.parts, model.shards)
    kinds = sorted({w for _, t, _ in rows for w in toks(t) if w}) + ["unseen"]
    for history in ("w1", "w0 w2", "the", "w3 unseen", "unseen", ""):
        p = []
        for w in [*kinds, None]:
            now, before, begin = keys_of(f"{history} {w or ''}")
            at = len(toks(history)) - 1
            p.append([float(c[at]) for c in model.chains(*B.levels_of(probes, now, before, begin, 3)[:3], begin)])
        p = np.array(p).sum(axis=0)
        assert abs(p[0] - 1) < 0.03 and p[1] < 1.03 and p[2] < 1.03 and p[1] > 0.5


def brute(rows, keep, model):
    """log10 probabilities of the texts, with counts from dictionaries in place of the filter."""
    low = lambda c: int(B._LEAST[B.level(np.array([c]))[0]]) if c else 0
    high = lambda c: int(B._MOST[B.level(np.array([c]))[0]]) if c else 0
    one, two, three = Counter(), Counter(), Counter()
    for d, t, _ in rows:
        if keep(d):
            w = ["<s>", *toks(t)]
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    n = sum(c for w, c in one.items() if w != "<s>")
    levels = {w: B.level(np.array([c]))[0] for w, c in one.items() if w != "<s>"}
    mean = {x: np.mean([one[w] for w in levels if levels[w] == x]) for x in levels.values()}
    out = []
    for d, t, _ in rows:
        w, sums = ["<s>", *toks(t)], np.zeros(3)
        for i in range(1, len(w)):
            p1 = (mean[levels[w[i]]] - model.discount if w[i] in levels else model.discount * len(levels)) / n
            context = one["<s>"] if i == 1 else high(one[w[i - 1]])
            p2 = (low(two[w[i - 1], w[i]]) + B.PRIOR * p1) / (context + B.PRIOR)
            p3 = p2 if i == 1 else (low(three[w[i - 2], w[i - 1], w[i]]) + B.PRIOR * p2) / (high(two[w[i - 2], w[i - 1]]) + B.PRIOR)
            sums += np.log10([p1, p2, p3])
        sums = sums[: model.order]
        out.append(((d is None, d or 0), math.log10(np.array(B.SHARES[model.order]) @ 10.0**sums) if sums.max() > -300 else sums.max()))
    return sorted(out)


@pytest.mark.parametrize(("part_bytes", "order"), [(B.PART_BYTES, 2), (B.PART_BYTES, 3), (200, 3)])
def test_score_equals_brute_force(spark, part_bytes, order):
    df, rows = table(spark, 300)
    model, counts = B.train(df.filter(~B.held_out(F.col("doc_id"))), part_bytes=part_bytes, order=order)
    assert (len(model.parts) > 1) == (part_bytes == 200)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["score"]) for r in B.score(df, model, counts).collect())
    want = brute(rows, lambda d: not out(d), model)
    far = [abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)]
    # False positives of the filter touch a few tokens in a thousand.
    assert [a[0] for a in got] == [b[0] for b in want] and np.median(far) < 1e-6 and max(far) < 2


def test_repeated_text_scores_higher_and_long_text(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    twice, long = text(60), text(200_000)
    rows = [(i, text(60), 0.0) for i in range(200)] + [(1000, twice, 0.0), (1001, twice, 0.0), (1002, long, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in B.score(df, *B.train(df)).collect()}
    assert got[1000]["score"] == got[1001]["score"] > got[5]["score"] + 5
    assert got[1002]["n_tokens"] == 200_001 and math.isfinite(got[1002]["score"])


def test_narrow_round_trip():
    rng = np.random.default_rng(4)
    for top in (1, 255, 256, 2**40, 2**63):
        x = rng.integers(0, top, 50, dtype=np.uint64)
        assert (B.wide(B.narrow(x)) == x).all()
    keys = np.unique(rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64))
    for kind, k in ((1, keys), (2, np.unique(keys & B._KEPT))):
        counts = rng.integers(1, 4, len(k))
        got = sorted(x for row in B._packed(kind, k, counts, 8) for x in zip(*(y.tolist() for y in B._unpacked(*row, 8)), strict=True))
        assert got == list(zip(k.tolist(), counts.tolist(), strict=True))


@pytest.mark.parametrize("order", [2, 3])
def test_no_task_has_the_whole_model(spark, monkeypatch, order):
    """Beyond the size up to which the filter is broadcast, the scores are right without any part going to all workers."""
    df, rows = table(spark, 200)
    learn = ~B.held_out(F.col("doc_id"))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("the model was broadcast"))
    apart = B.score(df, *B.train(df.filter(learn), order=order))
    model, at_once = B.train_and_score(df, learn, order=order, stretch=50, small=0)
    assert model.shards >= 16
    want = brute(rows, lambda d: not out(d), model)
    c = Counter(w for d, t, _ in rows if not out(d) for w in toks(t))
    known = sorted(((d is None, d or 0), sum(c[w] > 0 for w in toks(t))) for d, t, _ in rows)
    for scored in (apart, at_once):
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["score"], r["n_known"]) for r in scored.collect())
        far = [abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)]
        assert [(a[0], a[2]) for a in got] == known and np.median(far) < 1e-6 and max(far) < 2


@pytest.mark.parametrize(("order", "part_bytes"), [(2, B.PART_BYTES), (3, 200)])
def test_broadcast_and_shards_give_the_same(spark, monkeypatch, order, part_bytes):
    df, _ = table(spark, 200)
    learn = ~B.held_out(F.col("doc_id"))
    monkeypatch.setattr(B, "PART_BYTES", part_bytes)
    plain, sent = type(spark.sparkContext).broadcast, []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or plain(self, value))
    rows = [sorted(map(tuple, B.train_and_score(df, learn, order=order, stretch=50, small=small)[1].collect()), key=str) for small in (0, B.SMALL)]
    assert rows[0] == rows[1] and len(rows[0]) == df.count()
    parts = [x for x in sent if isinstance(x, B.Part)]
    assert len(parts) > 1 if part_bytes == 200 else len(parts) >= 1
    assert sum(len(p.filter.bytes) for p in parts) > 0
    empty = df.limit(0)
    assert B.train_and_score(empty, learn)[1].count() == 0


def test_ids_of_other_types(spark):
    df, rows = table(spark, 20)
    named = df.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    _, scored = B.train_and_score(named, F.lit(True))
    got = scored.collect()
    assert scored.schema["doc_id"].dataType.simpleString() == "string"
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in got) == sorted(("" if d is None else f"n{d}", len(toks(t))) for d, t, _ in rows)


def test_counts_round_trip():
    keys = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x10C6F7A0B5ED8D)
    counts = np.where(np.arange(2000) % 7 == 0, 0, np.where(np.arange(2000) % 5 == 0, np.arange(2000) * 1000, 1))
    rows = list(B._packed(1, keys, counts, 4))
    assert len(rows) == len({r[1] for r in rows})
    got = [x for row in rows for x in zip(*(y.tolist() for y in B._unpacked(*row, 4)), strict=True)]
    assert got == list(zip(keys.tolist(), counts.tolist(), strict=True))
