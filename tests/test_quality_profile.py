from collections import Counter

from locuspark.operators.reads_qc import phred_histogram


def test_histogram_of_reads_of_any_length(spark):
    reads = [("a", "IIH"), ("a", "IHG#"), ("a", ""), ("a", None), ("b", "!"), (None, "~~")]
    counts, total = Counter(), Counter(k for k, _ in reads)
    for key, qual in reads:
        counts.update((key, p, ord(c) - 33) for p, c in enumerate(qual or "", 1))
    got = {(r["k"], r["pos"], r["score"]): round(r["perc"], 9) for r in phred_histogram(spark.createDataFrame(reads, "k string, qual string"), ["k"]).collect()}
    assert got == {key: round(100 * n / total[key[0]], 9) for key, n in counts.items()}
    whole = phred_histogram(spark.createDataFrame(reads, "k string, qual string"), [])
    assert {(r["pos"], r["score"]): r["perc"] for r in whole.filter("pos = 4").collect()} == {(4, 2): 100 / 6}
