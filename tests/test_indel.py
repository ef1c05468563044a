import random

import pytest

from locuspark.operators import indel, similarity


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _plain(seqs):
    """Near pairs and centroids, one sequence after another."""
    order = sorted(seqs, key=lambda k: (-len(seqs[k]), k))
    pairs = {}
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if 10 * len(seqs[b]) >= 9 * len(seqs[a]) and 10 * (d := _distance(seqs[a], seqs[b])) <= len(seqs[a]):
                pairs[a, b] = d
    found = {}
    for b in order:
        near = [(pairs[a, b], -len(seqs[a]), a) for a in order if found.get(a) == a and (a, b) in pairs]
        found[b] = min(near)[2] if near else b
    return pairs, found


def _families(seed, shortest, longest):
    """Sequences with up to an eighth of their letters changed, put in or left out."""
    rng, seqs = random.Random(seed), {}
    for _ in range(7):
        root = "".join(rng.choices("ACGT", k=rng.randint(shortest, longest)))
        for _ in range(7):
            x = list(root)
            for _ in range(rng.randint(0, len(root) // 8)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choices("ACGT", k=rng.randint(0, 1))
            seqs[len(seqs) + 1] = "".join(x)
    return seqs


@pytest.mark.parametrize(("seed", "shortest", "longest", "heavy"), [(1, 32, 48, 2000), (2, 60, 120, 2000), (3, 32, 40, 1), (4, 5, 14, 2000)])
def test_near_pairs_and_centroids(spark, monkeypatch, seed, shortest, longest, heavy):
    monkeypatch.setattr(similarity, "HEAVY", heavy)
    seqs = _families(seed, shortest, longest)
    pairs, found = _plain(seqs)
    rows = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    assert {(r["a"], r["b"]): r["dist"] for r in indel.near_pairs(rows).collect()} == pairs
    got = indel.clusters(rows.withColumnRenamed("id", "poploc"))
    assert {r["poploc"]: r["cluster"] for r in got.collect()} == found
    assert 7 <= len(set(found.values())) < len(seqs)


def test_a_chain_has_centroids_in_turn(spark):
    chain = [(k, k + 1, 40, 1) for k in range(1, 9)]
    rows = spark.createDataFrame(chain, "a long, b long, len_a int, dist int")
    assert {(r["b"], r["a"]) for r in indel.greedy(rows).collect()} == {(2, 1), (4, 3), (6, 5), (8, 7)}


def test_no_and_equal_sequences(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ACGT" * 10), (4, "ACGT" * 10)], "poploc long, seq string")
    assert {r["poploc"]: r["cluster"] for r in indel.clusters(rows).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert indel.clusters(rows.limit(0)).count() == 0


def test_records(spark):
    rows = spark.createDataFrame([(1, "A" * 40), (2, "A" * 41), (5, "C" * 40)], "poploc long, seq string")
    got = {r["line"].replace("\t", " ") for r in indel.records(rows, indel.clusters(rows)).collect()}
    assert got == {"S 0 41 * * * * * L2 *", "H 0 40 * * * * * L1 L2", "C 0 2 * * * * * L2 *", "S 1 40 * * * * * L5 *", "C 1 1 * * * * * L5 *"}
