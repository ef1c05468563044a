import random

from pyspark.sql import functions as F

import corpus_pipeline as C


def test_stages_on_a_small_corpus(spark, tmp_path):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(C.STAGES):
        after = stage(spark, before, folder)
        if i < len(C.STAGES) - 1:
            assert after.columns == docs.columns, name
            after.write.parquet(str(tmp_path / name))
            after = spark.read.parquet(str(tmp_path / name))
            if i < 3:
                ids = {r["doc_id"] for r in before.select("doc_id").collect()}
                assert {r["doc_id"] for r in after.select("doc_id").collect()} <= ids and after.count() <= before.count()
                assert after.count() > 0.5 * before.count()
            before = after
    tokens = after.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert tokens <= 1024


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, labels):
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(0.5)).withColumn("same", F.lit(1)).withColumn("gone", F.lit("g")).withColumn("a.b", F.lit("c"))
    extra.repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "be", "cor", "du", "el", "fi"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        t = text(rng.randrange(20, 70))
        if i % 6 == 0:
            t += " zorgan vexx zorgbe vexx"
        rows.append((i, t, "en", rng.choice("ab"), len(t)))
        if i % 10 != 9:
            labels.append((i, 1, int(i % 6 == 0)))
    shared = "this line of eleven words is found in some of the texts"
    clean = {300: text(60) + "\n" + shared, 301: shared + "\n" + text(60), 302: text(90)}
    clean[303] = clean[302] + " more"
    rows += [(d, t, "en", "b", len(t)) for d, t in clean.items()]
    rows += [(304, None, None, None, None), (305, "", "en", "a", 0), (None, text(40), None, "a", 1), (302, clean[302], "en", "b", 1), (306, text(30_000), "de", "c", 1)]
    return rows, labels, shared, clean


def test_every_stage_on_odd_rows(spark, tmp_path):
    rows, labels, shared, clean = corpus()
    folder = str(tmp_path / "in")
    docs = tables(spark, folder, rows, labels)
    stages = dict(C.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    gone = ids(docs) - ids(kept)
    assert gone <= {i for i in range(240) if i % 6 == 0} and len(gone) > 35
    assert kept.filter("doc_id is null or doc_id in (304, 305)").count() == 3 and kept.filter("doc_id = 302").count() == 2

    lines = stages["line_dedup"](spark, docs, folder)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    got = texts(lines)
    assert got[300] == clean[300] and shared not in got[301] and got[304] is None and got[305] == "" and got[302] == clean[302]
    assert {r["doc_id"]: r["n_chars"] for r in lines.collect()}[301] == len(got[301])

    ones = stages["ngram_join"](spark, docs, folder)
    assert ones.columns == docs.columns and ids(ones) >= set(range(240)) | {None, 302, 306} and 303 not in ids(ones)
    assert ones.filter("doc_id = 302").count() == 1 and ones.filter("text is null or text = ''").count() == 1

    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(r[0], r[1]) for r in rows}
    packed = stages["packing"](spark, docs, folder).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 306) == next(r["doc_tokens"] for r in packed if r["doc_id"] == 306)
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows}

    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_run_equals_stage_by_stage_brute_force(spark, tmp_path):
    """The first three stages against plain Python on what they are given, and run() against all of them."""
    rows, labels, _, _ = corpus()
    folder = str(tmp_path / "in")
    docs = tables(spark, folder, rows, labels)
    before = docs
    for name, stage in C.STAGES[:4]:
        after = stage(spark, before, folder)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "line_dedup":
            seen, want = {}, []
            order = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in before.collect() if r["text"] is not None), key=lambda x: x[:2])
            for none, d, t in order:
                if t not in seen:
                    seen[t] = "\n".join(x for x in t.split("\n") if not any(x.split() == y.split() != [] for o in seen for y in o.split("\n")))
                want.append((None if none else d, seen[t]))
            assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in after.collect() if r["text"] is not None)
        if name == "ngram_join":
            grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
            kept = [(r["doc_id"], r["text"] or "") for r in after.collect()]
            sets = {k: grams(k[1]) for k in kept}
            for r in before.collect():
                own = grams(r["text"] or "")
                near = [k for k, s in sets.items() if k[1] == (r["text"] or "") or (own and len(own & s) >= 0.8 * len(own | s) - 1e-9)]
                assert len(near) >= 1
            assert all(len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) for i, a in enumerate(kept) for b in kept[:i] if sets[a] or sets[b])
        before = after
    key = lambda r: (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, C.run(spark, folder).collect())) == sorted(map(key, C.STAGES[4][1](spark, before, folder).collect()))
