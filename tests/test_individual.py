import random

import pytest
from pyspark.sql import functions as F

from locuspark.operators import individual as I

from plain_groups import build_groups


def test_groups_of_cliques_sum():
    groups, lost, more = build_groups([("AC", 5.0), ("AG", 4.0)], False)
    assert groups == [("AC", 5.0), ("AG", 4.0)] and (lost, more) == (0, 0)
    groups, lost, more = build_groups([("AN", 2.0), ("AC", 5.0)], False)
    assert groups == [("AC", 7.0)] and (lost, more) == (0, 0)


def test_promiscuous_without_survivor():
    groups, lost, more = build_groups([("ANC", 1.0), ("NGC", 1.0), ("TNC", 1.0)], False)
    assert groups == [] and (lost, more) == (2, 1)


def test_promiscuous_with_two_survivors():
    rows = [("AC", 6.0), ("AG", 2.0), ("AN", 4.0)]
    groups, lost, more = build_groups(rows, False)
    assert groups == [("AC", 9.0), ("AG", 3.0)] and (lost, more) == (0, 1)
    groups, lost, more = build_groups(rows, True)
    assert groups == [("AC", 6.0), ("AG", 2.0)]


def test_promiscuous_with_one_survivor():
    # NC fits AC, and NC fits TN; TN does not fit AC.
    rows = [("AC", 6.0), ("NC", 3.0), ("TN", 3.0)]
    groups, lost, more = build_groups(rows, False)
    assert groups == [("AC", 8.0)] and (lost, more) == (1, 1)
    groups, _, _ = build_groups(rows, True)
    assert groups == [("AC", 6.0)]


@pytest.mark.parametrize(("n1", "want"), [(1, 1), (5, 1), (6, 2), (10, 2), (20, 4), (50, 9)])
def test_binomial_cut(spark, n1, want):
    assert spark.range(1).select(I.binom_least(F.lit(n1), F.lit(0), 0.01)).first()[0] == want
    with pytest.raises(ValueError):
        I.binom_least(F.lit(1), F.lit(0), 0.5)


def used(spark, rows):
    return spark.createDataFrame([(1, 1, len(s), s, d, True) for s, d in rows], "ind long, loc long, sl int, seq string, depth long, good boolean")


def test_frequency_rule(spark):
    def call(rows, c=0.2):
        return {r["seq"]: r["corrected"] for r in I.snp_call_freq(used(spark, rows), c).collect()}

    assert call([("A", 10), ("C", 1)]) == {"A": "A", "C": "A"}
    assert call([("A", 10), ("C", 8), ("G", 1), ("N", 1)]) == {"A": "A", "C": "C", "G": "N", "N": "N"}
    assert call([("A", 10), ("N", 1)]) == {"A": "A", "N": "A"}
    assert call([("A", 10), ("C", 1)], -1) == {"A": "A", "C": "C"}
    assert call([("A", 2), ("C", 1)]) == {"A": "A", "C": "C"}  # the least depth is 0


def test_binomial_rule(spark):
    got = {r["seq"]: r["corrected"] for r in I.snp_call_binom(used(spark, [("A", 8), ("C", 4), ("G", 4), ("T", 1)])).collect()}
    assert got == {"A": "A", "C": "C", "G": "G", "T": "N"}


def test_thresholds_carry_forward(spark):
    rows = spark.createDataFrame([(1, 50), (1, 41), (2, 50)], "ind long, sl int")
    got = {(r["ind"], r["sl"]): r["dist"] for r in I.dist_asof(rows, [(32, 3), (41, 5)], ["ind"]).collect()}
    assert got == {(1, 41): 5, (1, 50): 5, (2, 50): 3}
    strict = {(r["ind"], r["sl"]): r["dist"] for r in I.dist_asof(rows, [(32, 3), (41, 5)], ["ind"], strict=True).collect()}
    assert strict[(2, 50)] == 5


def test_rare_svars_need_exactly_one_locus(spark):
    svars = spark.createDataFrame([(1, 8, "AAAAAAAA", 9), (1, 8, "CCCCCCCC", 9), (1, 8, "AAAAAAAT", 1), (1, 8, "AAAACCCC", 1), (1, 8, "GGGGTTTT", 1)], "ind long, sl int, seq string, depth long")
    got = {r["seq"]: r["loc"] for r in I.loci_of(svars, 4, F.lit(1), F.lit(4)).collect()}
    assert got == {"AAAAAAAA": 1, "CCCCCCCC": 2, "AAAAAAAT": 1}


def test_chain_is_one_locus(spark):
    svars = spark.createDataFrame([(1, 4, s, 9) for s in ("AAAA", "AAAT", "AATT")], "ind long, sl int, seq string, depth long")
    assert {r["loc"] for r in I.loci_of(svars, 4, F.lit(1), F.lit(1)).collect()} == {1}


@pytest.mark.parametrize("binom", [False, True])
def test_groups_equal_the_plain_rule_on_random_loci(spark, binom):
    rng = random.Random(11)
    loci = {}
    for loc in range(10_000):
        sl, letters = rng.choice([(2, "ACN"), (3, "ACN"), (4, "ACGTN"), (70, "AN")])
        base = ["A"] * sl
        rows = []
        for _ in range(rng.randrange(1, 7)):
            s = list(base)
            for _ in range(rng.randrange(0, 4)):
                s[rng.randrange(min(sl, 4)) * (1 if sl < 9 else 17)] = rng.choice(letters)
            rows.append(("".join(s), rng.randrange(1, 20)))
        loci[loc] = rows
    flat = [(1, loc, len(rows[0][0]), sum(d for _, d in rows), f"{i}", d, s) for loc, rows in loci.items() for i, (s, d) in enumerate(rows)]
    df = spark.createDataFrame(flat, "ind long, loc long, sl int, loc_dep long, seq string, depth long, corrected string")
    got = {}
    for r in I.groups_of(df, binom).collect():
        groups, figures = got.setdefault(r["loc"], ([], (r["lost"], r["more"])))
        assert figures == (r["lost"], r["more"])
        groups += [(r["seq"], round(r["depth"], 6))] if r["seq"] is not None else []
    for loc, rows in loci.items():
        groups, lost, more = build_groups([(s, float(d)) for s, d in rows], binom)
        assert sorted(got[loc][0]) == sorted((s, round(d, 6)) for s, d in groups) and got[loc][1] == (lost, more), (loc, rows)


def test_long_sequences_are_corrected_position_by_position(spark):
    base = "ACGT" * 40
    rows = [(base, 50), (base[:65] + "T" + base[66:], 1), (base[:130] + "N" + base[131:], 1), (base[:2] + "A" + base[3:], 40)]
    got = {r["seq"]: r["corrected"] for r in I.snp_call_freq(used(spark, rows)).collect()}
    assert got == {rows[0][0]: base, rows[1][0]: base, rows[2][0]: base, rows[3][0]: rows[3][0]}


def test_a_locus_of_a_hundred_thousand_svars(spark):
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.substr(F.lit("ACGT"), 1 + F.pmod(F.floor(F.col("id") / F.pow(F.lit(4), i)), F.lit(4)).cast("int"), F.lit(1))), "")
    svars = spark.range(100_000).select(F.lit(1).cast("long").alias("ind"), F.lit(1).cast("long").alias("loc"), F.lit(41).alias("sl"), F.concat(F.lit("A" * 32), letters).alias("seq"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("good"))
    got = I.snp_call_freq(svars, 0.2)
    assert got.count() == 100_000 and got.filter("length(corrected) = 41 and loc_dep = 100000").count() == 100_000


def test_tables_that_grow_are_not_broadcast(spark):
    from locuspark.operators import individual, similarity

    rows = spark.createDataFrame([(i, 1, 8, s, 5, True) for i in range(3) for s in ("ACGTACGT", "ACGTACGA", "ACGTACGN", "TTTTACGT")], "ind long, loc long, sl int, seq string, depth long, good boolean")
    corrected = individual.snp_call_binom(rows)
    near = similarity.similar_pairs(rows, ["ind"], "seq", 2, ignore_n=True)
    between = similarity.similar_between(rows, rows, ["ind"], "seq", "seq", 2, ignore_n=True)
    for df in (corrected, near, between, individual.groups_of(corrected), individual.rare_assign(rows.drop("loc"), rows, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


def test_a_position_has_one_replacement(spark):
    rows = [(1, 2, 20, p, *depths) for p, depths in enumerate([(9, 1, 0, 1, 1), (0, 0, 0, 0, 3), (8, 8, 1, 0, 2), (1, 1, 1, 1, 1), (9, 9, 0, 0, 0)])]
    sums = spark.createDataFrame(rows, "ind long, loc long, loc_dep long, pos int, A long, C long, G long, T long, N long")
    got = sorted((r["pos"], r["olds"], r["new"]) for r in I._replaced(sums, lambda col, dep: F.floor(dep * 0.2)).collect())
    assert got == [(0, "CTN", "A"), (2, "G", "N"), (3, "ACGT", "N")]


def test_consensus_by_codes(spark):
    rows = [(1, "ACGN" * 20), (1, "NCGN" * 20), (1, "ANNN" * 20), (2, "N"), (3, "T" * 20)]
    got = {r["g"]: r["seq"] for r in I._consensus(spark.createDataFrame(rows, "g long, seq string"), ["g"]).collect()}
    assert got == {1: "ACGN" * 20, 2: "N", 3: "T" * 20}


def test_loci_without_n_are_not_in_the_graph(spark, monkeypatch):
    seen, real = [], I._compatible
    monkeypatch.setattr(I, "_compatible", lambda seqs: seen.extend(r["loc"] for r in seqs.select("loc").distinct().collect()) or real(seqs))
    loci = {1: [("ACGT", 5), ("ACGA", 4)], 2: [("ACGT", 5), ("ACGN", 2)], 3: [("ACGT", 6), ("ACGA", 2), ("ACGN", 4)], 4: [("AAAA", 1)]}
    flat = [(1, loc, 4, sum(d for _, d in rows), s, d, s) for loc, rows in loci.items() for s, d in rows]
    df = spark.createDataFrame(flat, "ind long, loc long, sl int, loc_dep long, seq string, depth long, corrected string")
    got = {(r["loc"], r["seq"], r["depth"], r["lost"], r["more"]) for r in I.groups_of(df).collect()}
    assert sorted(seen) == [2, 3]
    assert got == {(1, "ACGT", 5.0, 0, 0), (1, "ACGA", 4.0, 0, 0), (2, "ACGT", 7.0, 0, 0), (3, "ACGT", 9.0, 0, 1), (3, "ACGA", 3.0, 0, 1), (4, "AAAA", 1.0, 0, 0)}
