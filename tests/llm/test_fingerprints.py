import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from locuspark.llm import winnowing as W

SCHEMA = "doc_id long, text string, source string, n_chars long, near_next double"


def brute(text, k=W.K, window=W.WINDOW):
    """Kept (hash, position) pairs by looking at each window in turn."""
    c = W.codes(text)
    if len(c) < k:
        return [(int(W.rolling(c, len(c))[0]), 0)] if len(c) else []
    h = [int(W.rolling(c[i : i + k], k)[0]) for i in range(len(c) - k + 1)]
    w = min(W.window_for(len(h), window), len(h))
    kept = {}
    for a in range(len(h) - w + 1):
        low = min(x >> 22 for x in h[a : a + w])
        at = max(i for i in range(a, a + w) if h[i] >> 22 == low)
        kept[at] = h[at]
    return [(kept[p], p) for p in sorted(kept)]


def test_winnowing_equals_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 15, 16, 17, 40, 200, 900):
        for letters in ("ab", "the quick brown föx 日本😀"):
            t = "".join(rng.choice(letters) for _ in range(n))
            h, p = W.winnow(W.codes(t))
            assert [(int(a), int(b)) for a, b in zip(h, p, strict=True)] == brute(t)


def test_long_text_in_blocks_equals_one_block(monkeypatch):
    rng = random.Random(4)
    c = W.codes("".join(rng.choice("abcdefgh ") for _ in range(5000)))
    whole = W.winnow(c)
    monkeypatch.setattr(W, "_BLOCK", 700)
    parts = W.winnow(c)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_shared_run_is_always_found():
    rng = random.Random(7)
    run = "".join(rng.choice("abcdefghij") for _ in range(W.WINDOW + W.K - 1))
    for n in (0, 30, 500, 3000):
        a = "".join(rng.choice("abcdefghij") for _ in range(n)) + run
        b = run + "".join(rng.choice("klmnop") for _ in range(2 * n + 5))
        assert set(W.winnow(W.codes(a))[0].tolist()) & set(W.winnow(W.codes(b))[0].tolist())


def rows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de") for _ in range(n)) for n in (300, 40, 0, 5, 1000, 77)]
    return [(3 * i + 1, t, "s", -1, 0.5) for i, t in enumerate(texts)] + [(50, None, None, None, None), (60, texts[0], "s", 0, 0.1)]


def test_edits_follow_the_next_document(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in W.fingerprint_edits(df).collect()}
    assert len(got) == len(data)
    data = [(d, t or "") for d, t, *_ in data]
    for i, (d, t) in enumerate(data):
        following = data[(i + 1) % len(data)][1]
        new = W.edited(t, following)
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        mine, other, nxt = (np.unique(W.winnow(W.codes(x))[0]) for x in (t, new, following))
        assert r["near_edited"] == W.likeness(mine, other) and r["near_next"] == W.likeness(mine, nxt)
        assert r["fingerprint"] == W.text_of(W.winnow(W.codes(t))[0]) and r["edited_fingerprint"] == W.text_of(W.winnow(W.codes(new))[0])
        assert r["positions"] == W.winnow(W.codes(t))[1].tolist()
    assert got[1]["fingerprint"] == got[60]["fingerprint"]


def test_empty_tables_and_null_ids(spark):
    assert W.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "x", None, None, None), (None, "x", None, None, None), (2, "y" * 9, "s", 1, 0.0)], SCHEMA)
    assert W.fingerprint_edits(df.repartition(3)).count() == 3
    assert W.fingerprint(df).filter(F.length("fingerprint") == 16).count() == 3


def following(data):
    """The next text of each row in ascending order of (id, hash of the text), null ids last."""
    return {data[i]: data[(i + 1) % len(data)][1] or "" for i in range(len(data))}


def test_ids_of_any_kind(spark, tmp_path):
    import datetime

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd ef") for _ in range(rng.randrange(90))) for _ in range(40)]
    day = datetime.date(2020, 1, 1)
    kinds = {"string": lambda i: f"doc-\u00e9-{i:05d}", "date": lambda i: day + datetime.timedelta(3 * i), "long": lambda i: (1 << 62) + i, "double": lambda i: i / 7 - 2, "int": lambda i: -i}
    for kind, made in kinds.items():
        data = [(made(i), t) for i, t in enumerate(texts)]
        path = str(tmp_path / kind)
        spark.createDataFrame(data, f"doc_id {kind}, text string").repartition(6).write.parquet(path)
        df = spark.read.parquet(path)
        got = {r["doc_id"]: r for r in W.fingerprint_edits(df).collect()}
        nxt = following(sorted(data))
        assert len(got) == 40
        for d, t in data:
            assert got[d]["edited_sha256"] == hashlib.sha256(W.edited(t, nxt[d, t]).encode()).hexdigest(), kind


def test_many_null_and_equal_ids(spark):
    texts = [f"text number {i} of those without an id" for i in range(60)]
    data = [(None, t) for t in texts] + [(7, "seven"), (7, "seven"), (7, "also seven"), (1, "")]
    df = spark.createDataFrame(data, "doc_id int, text string").repartition(5)
    tie = {r["text"]: r["t"] for r in df.select("text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, tie[r[1]]))
    want = sorted((str(d), hashlib.sha256(W.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in W.fingerprint_edits(df).collect()) == want


def test_one_window_for_all_lengths():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij ") for _ in range(900))
    for n in (526, 527, 600):
        a, b = (np.unique(W.winnow(W.codes(t))[0]) for t in (text[:n], text[: n + 1]))
        assert W.likeness(a, b) > 0.9
