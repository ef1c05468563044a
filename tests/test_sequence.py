import random
import time

import pytest
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.operators.similarity import similar_between, similar_pairs


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


def test_iupac():
    assert S.iupac_expand("RY") == ["AC", "AT", "GC", "GT"]
    assert S.iupac_regex("RA") == "[AG]A"


def test_revcomp_is_an_involution(spark):
    assert one(spark, S.revcomp(F.col("s")), s="ACGTN") == "NACGT"
    assert one(spark, S.revcomp(S.revcomp(F.col("s"))), s="AACGTNT") == "AACGTNT"


@pytest.mark.parametrize("n", [1, 59, 60, 61, 150])
def test_planes_agree_with_letters(spark, n):
    rng = random.Random(n)
    rows = [("".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("ACGTN") for _ in range(n))) for _ in range(20)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.planes_distance(S.planes(F.col("a")), S.planes(F.col("b")), True), S.planes_distance(S.planes(F.col("a")), S.planes(F.col("b")), False), S.hamming_ignore_n(F.col("a"), F.col("b")), S.hamming(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(rows, got, strict=True):
        loose = sum(x != y and "N" not in (x, y) for x, y in zip(a, b, strict=True))
        strict = sum(x != y for x, y in zip(a, b, strict=True))
        assert tuple(r) == (loose, strict, loose, strict)


def test_short_reads_are_judged_on_their_own_length(spark):
    assert one(spark, S.sliding_quality(F.col("q"), 5, 20), q="III") is True
    assert one(spark, S.sliding_quality(F.col("q"), 5, 20), q="!!") is False
    assert one(spark, S.sliding_quality(F.col("q"), 5, 20), q="") is True


def test_adapter_is_anchored_at_the_end(spark):
    assert one(spark, S.find_adapter(F.col("s"), ["ACGTACGT"], 0.0), s="TTTTTACGTA") == 5
    assert one(spark, S.find_adapter(F.col("s"), ["ACGTACGT"], 0.0), s="TTTTTTTT") == -1
    assert one(spark, S.find_adapter(F.col("s"), ["ACGT"], 0.0), s="ACG") == -1


def test_barcodes(spark):
    bars, sites = ["ACGT", "TGCA"], ["GATC"]
    assert one(spark, S.barcode_match(F.col("s"), bars, sites), s="ACGTGATCTT") == "ACGT"
    assert one(spark, S.barcode_match(F.col("s"), bars, sites), s="ACGTGAACTT") is None
    r = one(spark, S.barcode_repair(F.col("s"), bars, sites, 1, 1), s="ACTTGATGTT")
    assert (r["barcode"], r["seq"]) == ("ACGT", "ACGTGATCTT")
    # Both barcodes fit at two mismatches each: no repair.
    assert one(spark, S.barcode_repair(F.col("s"), ["AAAA", "CCCC"], sites, 2, 0), s="AACCGATCTT") is None


def test_consensus(spark):
    seqs = F.array(F.lit("ACGN"), F.lit("ATGN"), F.lit("ACGN"))
    df = spark.range(1)
    r = df.select(S.consensus_iupac(seqs), S.consensus_n_resolve(seqs), S.var_positions(seqs), S.varpos_text(S.var_positions(seqs))).first()
    assert tuple(r) == ("AYGN", "ATGN", [1], "p:2")


def naive(rows, d, ignore):
    out = set()
    for g, a in rows:
        for h, b in rows:
            if g == h and a < b and len(a) == len(b):
                n = sum(x != y and not (ignore and "N" in (x, y)) for x, y in zip(a, b, strict=True))
                if n <= d:
                    out.add((g, a, b, n))
    return out


@pytest.mark.parametrize("ignore", [True, False])
def test_similarity_join_equals_brute_force(spark, ignore):
    rng = random.Random(5)
    rows = set()
    for g in (1, 2):
        for _ in range(12):
            base = "".join(rng.choice("ACGT") for _ in range(20))
            for _ in range(4):
                s = list(base)
                for _ in range(rng.randrange(5)):
                    s[rng.randrange(20)] = rng.choice("ACGTN")
                rows.add((g, "".join(s)))
        rows.add((g, "N" * 20))
        rows.add((g, "ACG"))
        rows.add((g, "ANG"))
    df = spark.createDataFrame(sorted(rows), "g long, s string")
    got = {(r["g"], r["seq1"], r["seq2"], r["dist"]) for r in similar_pairs(df, ["g"], "s", 3, ignore).collect()}
    assert got == naive(rows, 3, ignore)
    both = similar_between(df.filter("g = 1"), df.filter("g = 1"), ["g"], "s", "s", 3, ignore).filter("seq1 < seq2").collect()
    assert {(r["g"], r["seq1"], r["seq2"], r["dist"]) for r in both} == naive({x for x in rows if x[0] == 1}, 3, ignore)


def test_iupac_variants(spark):
    rows = spark.createDataFrame([("RY",), ("nA",), ("AX",), ("",), (None,)], "p string")
    got = {r["p"]: r["v"] for r in rows.select("p", S.iupac_variants(F.col("p")).alias("v")).collect()}
    assert got == {"RY": S.iupac_expand("RY"), "nA": S.iupac_expand("NA"), "AX": None, "": [""], None: None} and S.iupac_expand("NA")[1] == "CA"


def seconds(df, expr):
    """The shorter of two runs."""
    took = []
    for _ in range(2):
        began = time.time()
        df.select(expr.alias("x")).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    return min(took)


def reads(spark, n):
    """Different strings of 32 letters of ACGTN and of 32 scores."""
    text = "".join(random.Random(7).choice("ACGTACGTACGTN") for _ in range(2000))
    qual = "".join(random.Random(8).choice("".join(map(chr, range(45, 74)))) for _ in range(2000))
    cut = "cast(1 + id * 7 % 1960 as int), 32)"
    df = spark.range(0, n, 1, 4).selectExpr(f"substr('{text}', {cut} as s", f"substr('{qual}', {cut} as q")
    return df.repartition(4).cache()


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 40, 41, 60, 61, 150])
def test_codes_agree_with_letters(spark, n):
    rng = random.Random(n)
    rows = [("".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("ACGTN") for _ in range(n))) for _ in range(30)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.codes_distance(S.codes(F.col("a")), S.codes(F.col("b")), True), S.codes_distance(S.codes(F.col("a")), S.codes(F.col("b")), False)).collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert tuple(r) == (sum(x != y and "N" not in (x, y) for x, y in zip(a, b, strict=True)), sum(x != y for x, y in zip(a, b, strict=True)))
    assert one(spark, S.codes_distance(S.codes(F.nullif("a", "a")), S.codes(F.col("a")), False), a="ACGT") is None


def letter_by_letter(s, adapters, rate, least=5):
    """``find_adapter`` with a lambda for each letter of each start."""

    def at(adapter):
        n, a = F.length(s), len(adapter)

        def fits(p):
            overlap = F.least(F.lit(a), n - p)
            wrong = F.aggregate(F.sequence(F.lit(1), overlap), F.lit(0), lambda t, k: t + F.when(F.substr(s, p + k, F.lit(1)) == F.substr(F.lit(adapter), k, F.lit(1)), 0).otherwise(1))
            return wrong <= F.floor(F.lit(float(rate)) * overlap)

        return F.when(n >= least, F.filter(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0))), fits)).otherwise(F.array().cast("array<int>"))

    return F.coalesce(F.array_min(F.concat(*[at(a) for a in adapters])), F.lit(-1))


@pytest.mark.parametrize(("adapters", "rate", "least"), [(["ACGTTGCA"], 0.25, 5), (["ACGTTG"], 0.0, 5), (["ACG", "TTGACCATAG"], 0.1, 5), (["ACGTTGCATGCA"], 0.4, 3), (["ACGT"], 1.0, 2), (["ACGT"], -0.1, 2)])
def test_adapters_are_those_of_the_definition(spark, monkeypatch, adapters, rate, least):
    monkeypatch.setattr(S, "BLOCK", 500)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGTN" if k % 3 else "ACT\u00e9\U0001f9ec\n") for _ in range(k % 40)) + adapters[0][: k % 9] + "A" * (k % 2) for k in range(400)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select(S.find_adapter(F.col("s"), adapters, rate, least), letter_by_letter(F.col("s"), adapters, rate, least)).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]
    assert df.filter("false").select(S.find_adapter(F.col("s"), adapters, rate, least)).count() == 0


def test_adapters_take_less_than_their_letters(spark):
    df = reads(spark, 60_000)
    assert 2 * seconds(df, S.find_adapter(F.col("s"), ["ACGTTGCA"], 0.25)) < seconds(df, letter_by_letter(F.col("s"), ["ACGTTGCA"], 0.25))


def window_by_window(qual, window, least, offset=33):
    """``sliding_quality`` with a lambda for each letter of each window."""
    w = F.least(F.length(qual), F.lit(window))
    low = lambda i: F.aggregate(F.slice(F.col("codes"), i + 1, w), F.lit(0), lambda t, x: t + x) < (least + offset) * w
    return F.when(F.length(qual) == 0, F.lit(True)).otherwise(~F.exists(F.sequence(F.lit(0), F.length(qual) - w), low))


@pytest.mark.parametrize("window", [1, 5, 31, 32, 40])
def test_windows_are_those_of_the_definition(spark, window):
    df = reads(spark, 2000).select(F.expr("substr(q, 1, cast(rand(5) * 33 as int))").alias("q")).withColumn("codes", F.transform(F.filter(F.split("q", ""), lambda c: c != ""), F.ascii))
    for least in (12, 20, 26):
        rows = df.select(S.sliding_quality(F.col("q"), window, least), window_by_window(F.col("q"), window, least)).collect()
        assert all(a == b for a, b in rows)


def test_windows_take_less_than_their_letters(spark):
    df = reads(spark, 200_000).withColumn("codes", F.transform(F.split("q", ""), F.ascii)).cache()
    assert seconds(df, S.sliding_quality(F.col("q"), 5, 12)) < seconds(df, window_by_window(F.col("q"), 5, 12))


def test_codes_take_less_than_planes(spark):
    df = reads(spark, 400_000)
    by = lambda make, distance: seconds(df.select(make(F.col("s")).alias("a"), make(S.revcomp(F.col("s"))).alias("b")), distance(F.col("a"), F.col("b"), False))
    assert by(S.codes, S.codes_distance) < by(S.planes, S.planes_distance)
