from locuspark.operators import demux
from locuspark.operators.demux import Demux


def one(spark, seq, settings, qual=None):
    df = spark.createDataFrame([(1, seq, qual or "I" * len(seq))], "id long, seq string, qual string")
    r = demux.single(df, settings).first()
    return r["dest"], r["ana"], r["seq"], r["good"]


def test_site_without_barcodes(spark):
    s = Demux(sites=("GATC",), repair_site=True, site_most=1)
    assert one(spark, "GATCAA", s) == ("SAMP", "clean", "GATCAA", 1)
    assert one(spark, "GTTCAA", s) == ("SAMP", "r1_rep", "GATCAA", 1)
    assert one(spark, "GTTTAA", s) == ("NN", "r1_rep_fail", "GTTTAA", 0)
    assert one(spark, "GTTCAA", Demux(sites=("GATC",))) == ("NN", "r1_c_fail", "GTTCAA", 0)


def test_barcodes_and_repairs(spark):
    s = Demux(sites=("GATC",), barcodes=("AAAA", "CCCCC"), repair_site_after_barcode=True, repair_barcode=True, repair_both=True, clip_site=True)
    assert one(spark, "AAAAGATCTT", s) == ("AAAA", "clean", "TT", 1)
    assert one(spark, "AAAAGTTCTT", s) == ("AAAA", "bcr_c_fail_bc_rrep", "TT", 1)
    assert one(spark, "AATAGATCTT", s) == ("AAAA", "bcr_c_fail_bc_rrep_fail_bcrep_r", "TT", 1)
    assert one(spark, "AATAGTTCTT", s) == ("AAAA", "bcr_c_fail_bc_rrep_fail_bcrep_r_fail_bcrep_rrep", "TT", 1)
    assert one(spark, "GGGGGGGGGG", s)[:2] == ("NN", "bcr_c_fail_bc_rrep_fail_bcrep_r_fail_bcrep_rrep_fail")
    even = Demux(sites=("GATC",), barcodes=("AAAA", "CCCCC"), even_barcodes=True)
    assert one(spark, "AAAAGATCTT", even)[2] == "GATCT" and one(spark, "CCCCCGATCTT", even)[2] == "GATCTT"


def test_quality_internal_site_and_adapter(spark):
    assert one(spark, "GATCAA", Demux(sites=("GATC",), window=3, window_score=20), "!!!III")[:2] == ("NN", "q_fail")
    assert one(spark, "GATCAATTAA", Demux(sites=("GATC",), internal_sites=("TTAA",)))[:2] == ("NN", "clean_rint")
    s = Demux(sites=("GATC",), adapters=("ACGTACGT",), adapter_rate=0.0, least_insert=3, mark_adapter=True, trunc_last=3)
    assert one(spark, "GATCTTTTTACGTACGTCC", s) == ("SAMP_ad", "clean_ad", "TTTTT", 1)
    assert one(spark, "GATCTACGTACGTCC", s)[:2] == ("NN", "clean_ads")
    assert one(spark, "GATCTTTTTT", s) == ("SAMP", "clean", "GAT", 1)


def pair(spark, f, r, fs, rs):
    df = spark.createDataFrame([(f, "I" * len(f), r, "I" * len(r))], "f_seq string, f_qual string, r_seq string, r_qual string")
    x = demux.paired(df, fs, rs).first()
    return x["f_dest"], x["r_dest"], x["f_seq"], x["r_seq"], x["r_ana"]


def test_pair_table(spark):
    s = Demux(sites=("GA",), adapters=("CCCCCC",), adapter_rate=0.0, internal_sites=("TGTGT",), clip_site=False)
    good, ad, bad, rint = "GATTTTTTTT", "GATTTCCCCCC", "TTTTTTTTTT", "GATGTGTTTT"
    assert pair(spark, good, good, s, s)[:2] == ("SAMP", "SAMP")
    assert pair(spark, good, bad, s, s)[:2] == ("SAMP_sg", "NN")
    assert pair(spark, bad, good, s, s)[:2] == ("NN", "SAMP_sg")
    assert pair(spark, bad, bad, s, s)[:2] == ("NN", "NN")
    assert pair(spark, rint, good, s, s) == ("NN", "NN", rint, good, "rint_pair")
    assert pair(spark, good, rint, s, s)[:2] == ("NN", "NN")
    marked = Demux(sites=("GA",), adapters=("CCCCCC",), adapter_rate=0.0, mark_adapter=True)
    assert pair(spark, ad, good, marked, marked)[:2] == ("SAMP_ad", "SAMP_ad")
    assert pair(spark, ad, bad, marked, marked)[:2] == ("SAMP_ad_sg", "NN")
    assert pair(spark, bad, ad, marked, marked)[:2] == ("NN", "SAMP_ad_sg")
    double = Demux(sites=("GA",), adapters=("CCCCCC",), adapter_rate=0.0, double_adapter=True)
    x = pair(spark, ad, good, double, double)
    assert x == ("SAMP", "SAMP", "TTT", "AAA", "ad_pair")
    x = pair(spark, bad, ad, double, double)
    assert x[:4] == ("SAMP", "SAMP", "AAA", "TTT")


def test_joined_mates(spark):
    s = Demux(sites=("GA",), join_mates=True)
    x = pair(spark, "GATT", "GACCC", s, s)
    assert x[2] == "GATTGGTC" and x[3] == "GACCAATC"


def test_adapters_by_the_barcode_of_the_forward_mate(spark):
    f = Demux(sites=("GATC",), barcodes=("AAAA", "CCCC"))
    r = Demux(sites=("GG",), barcode_adapters=(("AAAA", ("TTTTTT", "TTTTTA")), ("CCCC", ("ACACAC",))), adapter_rate=0.0, least_insert=1)
    insert = "GGCATCATCGG"
    rows = [(1, "AAAAGATCTT", insert + "TTTTTA"), (2, "CCCCGATCTT", insert + "TTTTTA"), (3, "CCCCGATCTT", insert + "ACACAC"), (4, "GGGGGATCTT", insert + "ACACAC")]
    df = spark.createDataFrame([(i, a, "I" * len(a), b, "I" * len(b)) for i, a, b in rows], "id long, f_seq string, f_qual string, r_seq string, r_qual string")
    got = {x["id"]: (x["r_seq"], x["r_ana"], x["f_dest"], x["r_dest"]) for x in demux.paired(df, f, r).collect()}
    assert got[1] == (insert[2:], "clean_ad", "AAAA", "AAAA") and got[3] == (insert[2:], "clean_ad", "CCCC", "CCCC")
    assert got[2] == (insert + "TTTTTA", "clean", "CCCC", "CCCC")
    assert got[4][:2] == (insert + "ACACAC", "clean")


def test_pairs_written_as_fastq(spark, tmp_path):
    from locuspark.sources import fastq

    rows = [("@1", "ACGT", "IIII", "@1r", "TTTT", "!!!!", "A", "A"), ("@2", "CCCC", "IIII", "@2r", "GGGG", "!!!!", "B_sg", "NN")]
    df = spark.createDataFrame(rows, "f_header string, f_seq string, f_qual string, r_header string, r_seq string, r_qual string, f_dest string, r_dest string")
    demux.write_fastq_pairs(df, str(tmp_path))
    f, r = (sorted((x["dest"], x["header"], x["seq"]) for x in fastq.read_folder(spark, f"{tmp_path}/{s}", ["dest"]).collect()) for s in "fr")
    assert f == [("A", "@1", "ACGT"), ("B_sg", "@2", "CCCC")] and r == [("A", "@1r", "TTTT")]
