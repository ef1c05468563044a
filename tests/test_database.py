import pytest
from pyspark.sql import functions as F

from locuspark.operators import depth, export, indel, pairs, population, selection, simulate
from locuspark.operators.individual import alleles, groups_of, loci_of, snp_call_freq, svar_count
from locuspark.operators.selection import Selection
from locuspark.sources import text_sinks


def links(spark, rows):
    return spark.createDataFrame(rows, "ind long, loc long, all_id long, poploc long, popall long, popallvar string, depth double")


def test_selection_only_narrows(spark):
    lk = links(spark, [(i, p, 1, p, p * 10, "A", 5.0) for i in range(4) for p in range(3) if (i, p) != (3, 0)])
    sel = Selection.default(population.link_loci(lk))
    one = sel.restrict(ind=sel.ind.filter("ind > 1"))
    two = one.restrict(loc=sel.loc.filter("poploc = 0"))
    assert (sel.gt.count(), one.gt.count(), two.gt.count()) == (11, 5, 1)
    assert [r["ind"] for r in two.ind.collect()] == [2] and [r["poploc"] for r in two.loc.collect()] == [0]
    other = sel.restrict(loc=sel.loc.filter("poploc = 0")).restrict(ind=sel.ind.filter("ind > 1"))
    assert other.gt.select("poploc", "ind").collect() == two.gt.select("poploc", "ind").collect()


def test_three_alleles_stop_a_diploid_export(spark):
    lk = links(spark, [(1, 1, k, 1, k, "A", 5.0) for k in (1, 2, 3)])
    gt = lk.select("poploc", "ind").distinct()
    with pytest.raises(Exception, match="more than two alleles"):
        export.gt_diploid(lk, gt, export.gt_renumber(export.gt_prune_alleles(lk, gt))).collect()


def test_invariant_neighbours_are_all_removed(spark):
    rows = spark.createDataFrame([(1, 1, "ACGT"), (1, 2, "ACGA")], "poploc long, popall long, popallvar string")
    assert sorted(r["trimmed"] for r in export.gt_trim_varpos(rows).collect()) == ["A", "T"]


def test_scaled_depth_without_spread_is_null(spark):
    rows = spark.createDataFrame([(1, 32, 1, 7)], "unit long, unit_sl int, ind long, dep long")
    r = depth.scaled(rows, [(1, 100)]).first()
    assert r["scaldep"] is None and r["dep_perc"] == 0.0


def test_groups_with_a_self_match_are_poisoned(spark):
    linked = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (1, 4, 4)], "ind long, loc1 long, loc2 long")
    loci = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "poploc long")
    groups = pairs.pair_groups(pairs.pair_counts(linked), loci)
    clean, selfs = pairs.poison_groups(groups, pairs.self_match(linked))
    assert sorted(r["poploc"] for r in clean.collect()) == [1, 2, 5]
    assert sorted((r["poploc"], r["n_seqpairs"]) for r in selfs.collect()) == [(3, 0), (4, 1)]


def test_three_reads_of_a_key_are_an_error(spark):
    rows = spark.createDataFrame([(1, "k", 1), (1, "k", 2), (1, "k", 3)], "ind long, pair_key string, poploc long")
    with pytest.raises(Exception, match="more than two reads"):
        pairs.read_pair_join(rows).collect()


def test_merged_halves(spark):
    rows = spark.createDataFrame([(1, 1, "AACCGGCCGGTT", 12), (1, 2, "AACCGGCCGGTA", 12), (2, 3, "AACCGGCCGGTT", 12), (2, 4, "AACCGACCGGTT", 12)], "poploc long, popall long, seq string, sl int")
    got = {r["popall"]: (r["merged"], r["lon_over"], r["lon_com_over"], r["merge_conflict"]) for r in population.merge_halves(rows, 12, 2, 5).collect()}
    assert got[1] == ("AACCGGTT", 4, 4, 0) and got[3] == ("AACCGGCCGGTT", 4, 0, 1)
    assert population.merge_settings(12, 8, 2) == (2, 4) and population.merge_settings(12, 11, 2) is None


def test_indel_clusters(spark):
    a = "ACGTTGCAACGGTTACCGATCGGATTACAGGCTTAACG"
    rows = spark.createDataFrame([(1, a), (2, a[:10] + a[12:]), (3, a[::-1])], "poploc long, seq string")
    assert {r["poploc"]: r["cluster"] for r in indel.clusters(rows).collect()} == {1: 1, 2: 1, 3: 3}


def test_simulated_genotypes_are_found(spark):
    s = simulate.Settings(inds=3, loci=8, reads=40, length=60, least_distance=20, mutations=2, indels=0, error=0.002, seed=2)
    truth = simulate.sim_database(spark, s)
    reads = simulate.sim_reads(truth, s)
    used = loci_of(svar_count(reads), 4, F.lit(8), F.lit(8))
    found = alleles(groups_of(snp_call_freq(used)))[1]
    got = {(r["ind"], r["seq"]) for r in found.collect()}
    want = {(r["ind"], r["seq"]) for r in truth.select("ind", "seq").distinct().collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 2


def test_text_formats(spark):
    dip = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 1, 1), (1, 2, 2, 2)], "poploc long, ind long, a1 int, a2 int")
    pops = spark.createDataFrame([(1, 1), (2, 2)], "ind long, pop int")

    def lines(df):
        return [r["line"] for r in df.orderBy("line_no").collect()]

    assert lines(text_sinks.structure(dip)) == ["1\t1\t1", "1\t2\t1", "2\t2\t-9", "2\t2\t-9"]
    assert lines(text_sinks.genepop(dip, pops)) == ["Title", "1", "2", "Pop", "1 , 0102 0101", "Pop", "2 , 0202 0000"]
    arl = lines(text_sinks.arlequin(dip, pops))
    assert arl[0] == "[Profile]" and "NbSamples=2" in arl and "1 1 1 1" in arl and "    2 ?" in arl
    seqs = spark.createDataFrame([("b", "ACGT"), ("a", "AC-T")], "name string, seq string")
    assert lines(text_sinks.fasta(seqs, F.col("name"))) == [">a\nAC-T", ">b\nACGT"]
    assert lines(text_sinks.phylip(seqs, F.col("name"))) == ["2 4", "a" + " " * 12 + "AC-T", "b" + " " * 12 + "ACGT"]
    assert lines(text_sinks.nexus(seqs, F.col("name")))[2:4] == ["DIMENSIONS NTAX=2 NCHAR=4;", "FORMAT DATATYPE=DNA MISSING=- GAP=N;"]


def test_dosage_alignment(spark):
    rows = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (1, 2, 0)], "poploc long, ind long, dosage int")
    assert {r["ind"]: r["seq"] for r in export.alignment_dosage(rows).collect()} == {1: "21", 2: "0-"}


def test_alignment_fills_missing_parts(spark):
    cells = spark.createDataFrame([(1, 1, 1, "AC"), (1, 1, 2, "AG"), (2, 1, 1, "T"), (2, 1, 2, "T"), (2, 2, 1, "G"), (2, 2, 2, "G")], "poploc long, ind long, copy int, part string")
    loci = spark.createDataFrame([(1, 2), (2, 1)], "poploc long, len int")
    inds = spark.createDataFrame([(1,), (2,)], "ind long")
    got = {(r["ind"], r["copy"]): r["seq"] for r in export.alignment(cells, loci, inds).collect()}
    assert got == {(1, 1): "ACT", (1, 2): "AGT", (2, 1): "NNG", (2, 2): "NNG"}


def test_selection_report(spark):
    lk = links(spark, [(i, 1, 1, 1, 1, "A", 5.0) for i in range(3)])
    sel = Selection.default(population.link_loci(lk))
    rows = selection.selection_report(sel, sel.restrict(ind=sel.ind.filter("ind = 0"))).collect()
    assert [tuple(r) for r in rows] == [("ind", 3, 1), ("loc", 1, 1), ("gt", 3, 1)]


def test_phased_copies_and_alignment_without_crossing(spark):
    lk = links(spark, [(i, 1, a, 1, a, v, 5.0) for i in range(40) for a, v in ((1, "AC"), (2, "GT"))] + [(50, 1, 1, 2, 3, "T", 5.0)])
    gt = lk.select("poploc", "ind").distinct()
    values = lk.select("poploc", "popall", "popallvar").distinct()
    one, two = (export.phased(lk, gt, values, "popallvar", seed) for seed in (1, 2))
    got = {(r["ind"], r["copy"]): r["part"] for r in one.filter("poploc = 1").collect()}
    assert all({got[i, 1], got[i, 2]} == {"AC", "GT"} for i in range(40)) and len({got[i, 1] for i in range(40)}) == 2
    assert sorted(map(tuple, one.collect())) != sorted(map(tuple, two.collect()))
    seqs = export.alignment(one, values.groupBy("poploc").agg(F.max(F.length("popallvar")).alias("len")), gt)
    assert "CartesianProduct" not in seqs._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in seqs._jdf.queryExecution().toString()
    rows = {(r["ind"], r["copy"]): r["seq"] for r in seqs.collect()}
    assert len(rows) == 82 and rows[50, 1] == rows[50, 2] == "NNT" and {rows[i, 1][:2] for i in range(40)} == {"AC", "GT"} and rows[0, 1][2] == "N"


def test_matrix_of_fifty_thousand_individuals(spark):
    n = 50_000
    cells = spark.range(n).filter("id % 7 <> 3").select((F.col("id") % 2).alias("poploc"), F.col("id").alias("ind"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("alleles"))
    index = export.individual_index(spark.range(n).select(F.col("id").alias("ind")))
    rows = export.matrix_rows(cells, "alleles", index)
    assert rows.count() == 100 and rows.agg(F.min(F.size("cells")), F.max(F.size("cells"))).first() == (1000, 1000)
    bad = export.matrix_cells(rows, index, "alleles").filter(F.col("alleles") != F.when((F.col("ind") % 7 != 3) & (F.col("ind") % 2 == F.col("poploc")), F.concat(F.lit("v"), F.col("ind").cast("string"))).otherwise("-999"))
    assert bad.count() == 0
    lines = export.matrix_lines(export.matrix_rows(cells.filter("ind < 5"), "alleles", export.individual_index(spark.range(5).select(F.col("id").alias("ind"))), block=2))
    assert {r["line"] for r in lines.collect()} == {"0\tv0\t-999\tv2\t-999\tv4", "1\t-999\tv1\t-999\t-999\t-999"}
