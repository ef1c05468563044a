import random

from pyspark.sql import functions as F

from locuspark.llm import toxicity as X


def tables(spark, n=500):
    rng = random.Random(5)
    syllables = ["an", "be", "cor", "du", "el", "fi", "go", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgan", "zorgbe", "zorgdu", "VEXX!"]))
        docs.append((i, " ".join(w), 0.5))
        if i % 10 != 9:
            labels.append((i, int(bad)))
    docs += [(n, None, None), (n + 1, "", None), (None, "go", None), (n + 2, "zorgfi an be du", None)]
    labels += [(0, 0), (None, 1), (n, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_texts(spark):
    docs, labels = tables(spark)
    aside = X.held_out(F.col("doc_id"))
    model = X.train(docs.filter(~aside), labels.filter(~aside))
    got = {r["doc_id"]: r["s"] for r in X.scored(docs.drop("score"), model, ["doc_id"]).withColumnRenamed("score", "s").collect()}
    assert len(got) == 504 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= X.THRESHOLD) == (i % 6 == 0) for i in range(500) if X.held_out is not None]
    assert sum(right) / len(right) > 0.95
    assert got[500] < 0.3 and got[501] < 0.3 and got[502] >= 0.3


def test_shared_backoff_of_unseen_words():
    rows = [(e, 5, 5) for e in X.events(b"aba")] + [(e, 1, 9) for e in X.events(b"zz")]
    m = X.Model(rows)
    assert m.word("ééé".encode()) == 0.0 and m.word(b"zz") > 0.5 and abs(m.word(b"aba")) < m.word(b"zz")


def test_no_labels(spark):
    docs, labels = tables(spark, 20)
    assert X.train(docs, labels.filter("toxic = 0")) is None
    assert X.train(docs.limit(0), labels.limit(0)) is None
    assert {r["score"] for r in X.scored(docs.drop("score"), None, ["doc_id"]).collect()} == {0.0}


def test_capped_sample_keeps_class_ratio(spark):
    # Labels that say nothing of the texts: scores are the share of toxic labels.
    docs = tables(spark, 1200)[0].drop("score")
    labels = spark.createDataFrame([(i, int(i % 7 == 3)) for i in range(1200)], "doc_id long, toxic int")
    got = [r["score"] for r in X.scored(docs, X.train(docs, labels, rows_per_class=100), ["doc_id"]).collect()]
    assert 0.08 < sum(got) / len(got) < 0.25
    x = [[float(i % 2), 0.0] for i in range(400)]
    y = [int(i % 2 == (i % 5 > 0)) for i in range(400)]
    X.np.random.seed(0)
    m = X.Model([("\x02a", 1, 1)])
    m.fit(X.np.array(x), X.np.array(y, dtype=float), (9.0, 1.0))
    z = X.np.array(x) @ X.np.array(m.curve[:2]) + m.curve[2]
    p, w = 1 / (1 + X.np.exp(-z)), X.np.where(X.np.array(y) > 0, 1.0, 9.0)
    assert abs((w * p).sum() / w.sum() - sum(y) / w.sum()) < 1e-3


def test_all_runs_kept_and_unseen_runs_backed_off():
    assert not hasattr(X, "EVENTS") and "max_events" not in X.train.__code__.co_varnames
    rows = [(e, 900, 1) for e in X.events(b"aba")] + [(e, 1, 90) for e in X.events(b"zb")]
    m = X.Model(rows)
    assert m.word(b"b") != 0.0
    assert list(m.words([b"aba", b"zb", b"b"])) == [m.word(b"aba"), m.word(b"zb"), m.word(b"b")]


def brute(rows, order, discount=X.DISCOUNT, back=X.BACK):
    """p_c(x | h) by looking at all counts each time: a function of class, context and symbol."""
    symbols = sorted({r[-1] for r, *_ in rows})
    seen = {r for r, *_ in rows}
    levels = [seen]
    while levels[-1]:
        levels.append({r[1:] for r in levels[-1] if len(r) > 1})

    def lower(h, x, depth):
        # Continuation counts: different left neighbours of h + x among the runs one level up.
        n = {s: sum(r[1:] == h + s for r in levels[depth - 1] if len(r) > 1) for s in symbols}
        total = sum(n.values())
        under = 1 / len(symbols) if not h else lower(h[1:], x, depth + 1)
        return under if not total else (max(n[x] - discount, 0) + discount * sum(v > 0 for v in n.values()) * under) / total

    def shared(h, x):
        n = {s: sum(a + b for r, a, b in rows if r == h + s) for s in symbols}
        return (max(n[x] - discount, 0) + discount * sum(v > 0 for v in n.values()) * lower(h[1:], x, 1)) / sum(n.values())

    def conditional(c, h, x):
        n = {s: sum(r[1 + c] for r in rows if r[0] == h + s) for s in symbols}
        met = [s for s in symbols if h + s in seen]
        p = {s: shared(h, s) for s in symbols}
        rest = max(0.0, 1 - sum(p[s] for s in met))
        g = {s: (n[s] + back) / (sum(n.values()) * (p[s] if s in met else rest) + back) for s in symbols}
        return p[x] * g[x] / sum(p[s] * g[s] for s in symbols)

    return symbols, conditional


def test_models_equal_brute_force_and_sum_to_one():
    import math
    from collections import Counter

    both = [Counter(), Counter()]
    for c, words in enumerate((["aba", "abba", "ba", "cab", "aba"], ["zaz", "abz", "zaz", "za"])):
        for w in words:
            both[c].update(X.events(w.encode(), 4))
    rows = [(k, both[0][k], both[1][k]) for k in both[0] | both[1]]
    symbols, conditional = brute(rows, 4)
    m = X.Model(rows, order=4)
    for h in {r[:-1] for r, *_ in rows}:
        assert all(abs(sum(conditional(c, h, x) for x in symbols) - 1) < 1e-9 for c in (0, 1))
    for w in ("aba", "zaz", "abaza", "cabz", "azb"):
        known = [(r[:-1], r[-1]) for r in X.events(w.encode(), 4) if any(r[:-1] == k[:-1] for k, *_ in rows)]
        want = sum(math.log(conditional(1, h, x) / conditional(0, h, x)) for h, x in known)
        assert abs(m.word(w.encode()) - want) < 1e-5, w


def test_columns_of_any_name_long_texts_and_repeats(spark):
    docs, labels = tables(spark)
    model = X.train(docs, labels)
    long = spark.createDataFrame([(900, "zorgan an be. " * 200_000, 0.5), (901, "zorgan an be", 0.5), (901, "zorgan an be", 0.5)], docs.schema)
    docs = docs.unionByName(long).withColumnRenamed("score", "Score").withColumn("figure", F.lit(1)).withColumn("a.b", F.lit("x"))
    out = X.scored(docs, model, docs.columns)
    assert out.columns == [*docs.columns, "score_"] and out.count() == docs.count()
    rows = [r for r in out.collect() if (r["doc_id"] or 0) >= 900]
    assert len(rows) == 3 and all(r["score_"] >= X.THRESHOLD and r["Score"] == 0.5 for r in rows)
    assert X.scored(docs.limit(0), model, docs.columns).count() == 0


def test_groups_of_texts(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 5)
    monkeypatch.setattr(X, "KNOWN", 2)
    assert list(X.groups(["abc", None, "de", "fghijk", ""])) == [["abc", "", "de"], ["fghijk"], [""]]
    m = X.Model([(e, 5, 1) for e in X.events(b"aba")] + [(e, 1, 9) for e in X.events(b"zz")])
    known, texts = X.Known(m), ["aba zz", "zz zz aba", "", "zz"]
    assert known.figures(texts) == [X.Known(m).figures([t])[0] for t in texts] and len(known) <= 2
