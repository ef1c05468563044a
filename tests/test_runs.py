import pytest
from pyspark.sql import functions as F

from locuspark.operators import database as D
from locuspark.operators import individual as I


def call(reads):
    svars = I.loci_of(I.svar_count(reads), 2, F.lit(1), F.lit(1))
    loci, alleles = I.alleles(I.groups_of(I.snp_call_freq(svars)))
    return {"alleles": alleles, "loci": loci}


def rows(spark, found):
    return spark.createDataFrame([(i, s) for i, seqs in found.items() for s in seqs], "ind long, seq string")


def ids(spark, *found):
    return spark.createDataFrame([(i,) for i in found], "ind long")


def state(spark, path):
    return {tuple(r[c] for c in ("batch", "ind", "success", "reason", "n_loci")) for r in D.status(spark, path).collect()}


def test_two_runs_with_a_bad_individual_and_a_rerun(spark, tmp_path):
    path = str(tmp_path / "db")
    good = ["ACGT"] * 3 + ["TTTT"] * 2
    D.append(path, "a", rows(spark, {1: good, 2: ["ACXT"] * 3}), ids(spark, 1, 2, 3), call)
    first = {("a", 1, 1, None, 2), ("a", 2, 0, "letters other than ACGTN", 0), ("a", 3, 0, "no reads", 0)}
    assert state(spark, path) == first
    D.append(path, "b", rows(spark, {2: good, 4: ["AAAA"]}), ids(spark, 2, 4), call)
    both = first | {("b", 2, 1, None, 2), ("b", 4, 0, "no locus", 0)}
    assert state(spark, path) == both
    before = sorted(map(tuple, D.table(spark, path, "alleles").collect()))
    D.append(path, "b", rows(spark, {2: ["CCCC"] * 9}), ids(spark, 2), call)
    assert state(spark, path) == both and sorted(map(tuple, D.table(spark, path, "alleles").collect())) == before
    assert {r["ind"] for r in D.table(spark, path, "alleles").collect()} == {1, 2}
    with pytest.raises(ValueError, match="individuals of other runs: 1"):
        D.append(path, "c", rows(spark, {1: good}), ids(spark, 1), call)


def test_a_run_broken_off_is_not_read_and_is_repeated(spark, tmp_path):
    path = str(tmp_path / "db")

    def breaks(reads):
        made = call(reads)
        made["alleles"].withColumn("batch", F.lit("a")).write.partitionBy("batch").parquet(f"{path}/alleles")
        raise RuntimeError("lost")

    D.append(path, "z", rows(spark, {9: ["GGGG"] * 3}), ids(spark, 9), lambda reads: {k: v for k, v in call(reads).items() if k == "loci"})
    with pytest.raises(RuntimeError):
        D.append(path, "a", rows(spark, {1: ["ACGT"] * 3}), ids(spark, 1), breaks)
    assert D.table(spark, path, "alleles").count() == 0
    D.append(path, "a", rows(spark, {1: ["TTTT"] * 5}), ids(spark, 1), call)
    assert [(r["ind"], r["seq"]) for r in D.table(spark, path, "alleles").collect()] == [(1, "TTTT")]


def test_reads_of_both_strands(spark):
    reads = spark.createDataFrame([(1, "AACC", "@r1_1"), (1, "GGTT", "@r2_1"), (1, "ACGT", "@r3_1"), (1, "TTTT", "@r4_1"), (2, "AACC", "@r5_1")], "ind long, seq string, header string")
    svars = spark.createDataFrame([(1, "AACC", 1), (1, "ACGT", 2), (1, "AAAA", 3), (2, "GGTT", 1)], "ind long, seq string, loc int")
    got = {(r["ind"], r["seq"], r["loc"], r["strand"], r["h"]) for r in I.reads_annotate(reads, svars, both_strands=True).withColumn("h", I.mate_header(F.col("header"), F.col("mate"))).collect()}
    assert got == {(1, "AACC", 1, "f", "@r1_1"), (1, "AACC", 1, "r", "@r2_2"), (1, "ACGT", 2, "f", "@r3_1"), (1, "ACGT", 2, "r", "@r3_2"), (1, "AAAA", 3, "r", "@r4_2"), (2, "GGTT", 1, "r", "@r5_2")}
