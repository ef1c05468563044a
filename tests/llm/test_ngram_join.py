import random

import numpy as np

from locuspark.llm import ngram_join as J

SCHEMA = "doc_id long, text string, class_id string"


def sets(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    n = len(rows)
    root, links, others = list(range(n)), [0] * n, [set() for _ in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [sets(t) for _, t, _ in rows]
    for a in range(n):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            both = len(s[a] & s[b])
            if same or (both and both >= 0.8 * (len(s[a]) + len(s[b]) - both) - 1e-9):
                links[a] += 1
                links[b] += 1
                if not same:
                    others[a].add(rows[b][1])
                    others[b].add(rows[a][1])
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    classes = [min(rows[i][0] for i in range(n) if find(i) == find(k)) for k in range(n)]
    return {(rows[k][0], classes[k], links[k], len(others[k])) for k in range(n)}


def table(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n // 4):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 6, 40, 120, 400]))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w), "clash"))
    return [*rows, (900, None, ""), (901, "", ""), (902, " \n", ""), (903, "one two", ""), (904, "one two", "")]


def got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {(r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in J.near_duplicates(df).collect()}


def test_equals_brute_force(spark):
    assert got(spark, table()) == brute(table())


def test_bands_as_groups_lose_no_link(spark, monkeypatch):
    rows, want = table(3), brute(table(3))
    monkeypatch.setattr(J, "BLOCK_DOCS", 2)
    for cost in (1e9, 0.0):  # every component as one group; none
        monkeypatch.setattr(J, "BAND_COST", cost)
        assert got(spark, rows) == want


def test_first_shared_band():
    a = np.arange(4 * J.HASHES, dtype=np.uint32).reshape(4, J.HASHES)
    b = a + np.uint32(1)
    b[1, 3 * J.ROWS : 5 * J.ROWS] = a[1, 3 * J.ROWS : 5 * J.ROWS]
    b[2, 1 : 1 + J.ROWS] = a[2, 1 : 1 + J.ROWS]
    b[3] = a[3]
    assert J.first_shared(a, b).tolist() == [J.BANDS, 3, J.BANDS, 0]


def test_a_chain_of_unlike_texts_goes_by_bands(spark, monkeypatch):
    # Each text shares four fifths with the next; the component is all of them, the bands are small.
    words = [f"w{i}" for i in range(6000)]
    rows = [(i, " ".join(words[20 * i : 20 * i + 200]), "") for i in range(250)]
    monkeypatch.setattr(J, "BLOCK_DOCS", 20)
    assert got(spark, rows) == brute(rows)


def test_components_that_go_by_bands(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_DOCS", 3)
    # A chain of five (each node shares a key of two with either neighbour), five that share all of 32 keys, and three in one block.
    chain, dense, small = range(5), range(10, 15), range(20, 23)
    members = [(0, v) for v in chain] + [(10, v) for v in dense] + [(20, v) for v in small]
    linked = [(v, 2) for v in chain for _ in range(1 if v in (0, 4) else 2)] + [(v, 5) for v in dense for _ in range(32)] + [(20, 2), (21, 2), (21, 2), (22, 2)]
    found = J.by_bands(spark.createDataFrame(members, "component long, node long"), spark.createDataFrame(linked, "node long, n long"))
    assert [r[0] for r in found.collect()] == [0]


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w), ""))
    monkeypatch.setattr(J, "BLOCK_DOCS", 20)
    assert got(spark, rows) == brute(rows)


def test_one_of_each(spark):
    rows = [(5, "a b c d e f g h", ""), (2, "a b c d e f g h", ""), (9, "z y x w v u", ""), (9, "z y x w v u", ""), (None, "q r s t u v", ""), (None, "q r s t u v", "")]
    kept = J.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "9", "None"]
    assert J.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_limits():
    limits = dict(J.least_matches())
    assert limits[16] < 16 * 0.8 and list(limits.values()) == sorted(limits.values())


def test_links_within_a_block_count_once(spark, monkeypatch):
    monkeypatch.setattr("locuspark.llm.ngram_join.BLOCK_GRAMS", 150)
    docs = []
    for g in range(12):
        words = [f"w{g}x{k}" for k in range(100)]
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words, "more"]))]
    from locuspark.llm import ngram_join

    out = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["n_text_links"], r["n_links"]) for r in out} == {(1, 1)}


def test_recall_of_pairs_near_the_threshold(spark):
    """Many pairs here lie between 0.8 and 0.9, where bands and pruning would lose the first ones."""
    rng = random.Random(6)
    rows, want, hard = [], 0, 0
    for g in range(150):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 120, 300]))]
        own = []
        for _ in range(4):
            w = list(base)
            at, run = rng.randrange(len(w)), rng.randrange(1, max(2, len(w) // 14))
            w[at : at + run] = [f"x{rng.randrange(10**6)}" for _ in range(run)]
            own.append(" ".join(w))
        s = [sets(t) for t in own]
        for a in range(4):
            for b in range(a):
                likeness = len(s[a] & s[b]) / len(s[a] | s[b])
                want += likeness >= 0.8
                hard += 0.8 <= likeness < 0.9
        rows += [(len(rows) + i, t, "") for i, t in enumerate(own)]
    found = sum(r["n_text_links"] for r in J.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) / 2
    assert hard > 150 and 0.999 * want <= found <= want


def test_very_long_texts_string_ids_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [("b", long, "x"), ("a", long + " end", "x"), ("c", "other words that are only here", "x")]
    out = J.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, same string")).collect()
    assert {(r["doc_id"], r["class_id"], r["n_text_links"]) for r in out} == {("a", "a", 1), ("b", "a", 1), ("c", "c", 0)}
    kept = J.one_of_each(spark.createDataFrame(rows, "doc_id string, text string, same string"))
    assert kept.columns == ["doc_id", "text", "same"] and {r["doc_id"] for r in kept.collect()} == {"a", "c"}
