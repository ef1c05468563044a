"""Queries on reads: scalar functions, quality, demultiplexing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.operators import demux, reads_qc
from locuspark.plans.scratch import scratch_dir
from locuspark.queries.fixtures import BARCODES, SITE, Fixture
from locuspark.sources import fastq

LIMITS = [(1, 20), (5, 15), (32, 14)]
ADAPTER = "ACGTTGCA"
SITES_INTERNAL = ["GATC", "TTAA"]
_D = "BIGINT"


def _keyed(df: DataFrame, **columns) -> DataFrame:
    return df.select("ind", "o", "i", "tl", *[c.alias(k) for k, c in columns.items()])


def _count(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _mism(s: str, pattern: str) -> str:
    return "(" + " + ".join(f"CASE WHEN substr({s}, {i + 1}, 1) = '{c}' THEN 0 ELSE 1 END" for i, c in enumerate(pattern)) + ")"


def revcomp(f: Fixture) -> DataFrame:
    return _keyed(f.reads, rc=S.revcomp(F.col("seq")))


def seq_length(f: Fixture) -> DataFrame:
    return _count(f.raw.select("ind", F.length("seq").alias("sl")), "ind", "sl")


def n_expand(f: Fixture) -> DataFrame:
    return _count(f.reads.select("ind", F.explode(S.n_expand(F.col("seq"))).alias("seq")), "ind", "seq")


def mismatch_prefix(f: Fixture) -> DataFrame:
    return _keyed(f.raw, wrong=S.mismatch_prefix(F.col("seq"), "ACGTGATCC").cast("long"))


def _to_revcomp(f: Fixture, ignore_n: bool) -> DataFrame:
    """Distances of reads to their reverse complements; codes are columns, so they are worked out once."""
    seq = F.col("seq")
    coded = f.reads.select("ind", "o", "i", "tl", S.codes(seq).alias("a"), S.codes(S.revcomp(seq)).alias("b"))
    return _keyed(coded, dist=S.codes_distance(F.col("a"), F.col("b"), ignore_n).cast("long"))


def hamming(f: Fixture) -> DataFrame:
    return _to_revcomp(f, False)


def hamming_ignore_n(f: Fixture) -> DataFrame:
    return _to_revcomp(f, True)


def simplify_header(f: Fixture) -> DataFrame:
    h = F.concat(F.lit("@M:1:F:"), F.col("o"), F.lit(":"), F.col("i"), F.lit(":"), F.col("tl"), F.lit(":9 1:N:0:"), F.col("ind"))
    return _keyed(f.reads, header=S.simplify_header(h, 1))


def sliding_quality(f: Fixture) -> DataFrame:
    return _keyed(f.reads_q, good=S.sliding_quality(F.col("qual"), 5, 20).cast("int"))


def trunc_to(f: Fixture) -> DataFrame:
    return _keyed(f.reads_q, seq=S.trunc_to(F.col("seq"), 20), qual=S.trunc_to(F.col("qual"), 20))


def site_starts(f: Fixture) -> DataFrame:
    return _keyed(f.reads, starts=S.site_starts(F.col("seq"), S.iupac_expand("RYN")).cast("int"))


def site_repair(f: Fixture) -> DataFrame:
    return _keyed(f.reads, fixed=S.site_repair(F.col("seq"), S.iupac_expand("GRTC"), 2))


def barcode_match(f: Fixture) -> DataFrame:
    return _keyed(f.raw, barcode=F.coalesce(S.barcode_match(F.col("seq"), BARCODES, [SITE]), F.lit("NN")))


def _repair(f: Fixture, b: int, s: int) -> DataFrame:
    r = S.barcode_repair(F.col("seq"), BARCODES, [SITE], b, s)
    return _keyed(f.raw, barcode=F.coalesce(r["barcode"], F.lit("NN")), fixed=F.coalesce(r["seq"], F.col("seq")))


def clip_prefix(f: Fixture) -> DataFrame:
    cut = S.site_length(F.col("seq"), S.iupac_expand("RC"))
    return _keyed(f.reads, clipped=F.when(cut.isNotNull(), F.substr(F.col("seq"), cut + 1)), ok=cut.isNotNull().cast("int"))


def compensate_barcode_len(f: Fixture) -> DataFrame:
    longest = max(map(len, BARCODES))
    b = S.barcode_match(F.col("seq"), BARCODES, [SITE])
    rest = F.substr(F.col("seq"), F.length(b) + 1)
    return _keyed(f.raw.withColumn("b", b).filter("b is not null"), seq=S.trunc_to(rest, F.length(rest) + F.length(b) - longest))


def internal_site(f: Fixture) -> DataFrame:
    return _keyed(f.reads, inside=S.internal_site(F.col("seq"), SITES_INTERNAL).cast("int"))


def find_adapter(f: Fixture) -> DataFrame:
    return _keyed(f.reads, start=S.find_adapter(F.col("seq"), [ADAPTER], 0.25).cast("long"))


def dup_revcomp_pair(f: Fixture) -> DataFrame:
    return _keyed(f.mates, r_seq=S.revcomp(F.col("f_seq")), r_qual=F.reverse("f_qual"))


def concat_revcomp_pair(f: Fixture) -> DataFrame:
    a, b = S.concat_revcomp(F.substr(F.col("f_seq"), F.lit(1), F.lit(14)), F.col("r_seq"))
    return _keyed(f.mates, f_seq=a, r_seq=b)


def split_fragments(f: Fixture) -> DataFrame:
    return _count(f.reads.select(F.posexplode(S.fragments(F.col("seq"), F.lit(4))).alias("k", "fragment")), "k", "fragment").withColumn("k", F.col("k").cast("long"))


def half_overlaps(f: Fixture) -> DataFrame:
    return _count(f.reads.select(F.explode(S.half_overlaps(F.col("seq"), 2, 8)).alias("overlap")), "overlap").withColumn("overlap", F.col("overlap").cast("long"))


def iupac_expand(f: Fixture) -> DataFrame:
    """What the codes of the first letters of reads, a site's pattern before them, may stand for."""
    patterns = f.reads.select(F.concat(F.lit("RY"), F.substr(F.col("seq"), F.lit(1), F.lit(6))).alias("pattern")).distinct()
    return patterns.select("pattern", F.posexplode(S.iupac_variants(F.col("pattern"))).alias("k", "variant")).withColumn("k", F.col("k").cast("long"))


def phred_histogram(f: Fixture) -> DataFrame:
    h = reads_qc.phred_histogram(f.reads_q, ["ind"])
    return h.select("ind", F.col("pos").cast("long").alias("pos"), F.col("score").cast("long").alias("score"), F.round("perc", 6).alias("perc"))


def phred_pos_filter(f: Fixture) -> DataFrame:
    return _count(reads_qc.phred_pos_filter(f.reads_q, LIMITS), "ind")


def phred_pos_filter_pair(f: Fixture) -> DataFrame:
    return _count(reads_qc.phred_pos_filter_pair(f.mates, [(1, 20), (3, 18)], [(2, 16)]), "ind")


def phred_filter_report(f: Fixture) -> DataFrame:
    r = reads_qc.phred_filter_report(f.reads_q, "ind", LIMITS)
    return r.withColumn("prop_bad", F.round("prop_bad", 6))


DEMUX = demux.Demux(sites=(SITE,), barcodes=tuple(BARCODES), repair_site_after_barcode=True, repair_barcode=True, clip_barcode=True, clip_site=True, internal_sites=("TTAAC",), trunc_last=28)


def fdm_single(f: Fixture) -> DataFrame:
    return _keyed(demux.single(f.raw, DEMUX), dest=F.col("dest"), ana=F.col("ana"), seq=F.col("seq"))


def fdm_tree(f: Fixture) -> DataFrame:
    t = demux.tree(f.raw, DEMUX)
    return _keyed(t, dest=F.col("_t.dest"), ana=F.col("_t.ana"), good=F.col("_t.good"), override=F.col("_t.override"))


def fdm_report(f: Fixture) -> DataFrame:
    return demux.report(demux.single(f.raw, DEMUX))


def fdm_demux(f: Fixture) -> DataFrame:
    """Reads written as gzip FASTQ files by destination, and read again."""
    path = f"{scratch_dir(f.spark)}/{uuid.uuid4().hex}"
    named = f.stage("demuxed", lambda: demux.single(f.raw, DEMUX)).withColumn("header", F.concat(F.lit("@r_"), "ind", F.lit("_"), "o", F.lit("_"), "i", F.lit("_"), "tl"))
    demux.write_fastq(named, path, compress=True)
    return _count(fastq.read_folder(f.spark, path, ["dest"]), "dest", "header", "seq")


def fdm_pair(f: Fixture) -> DataFrame:
    s = demux.Demux(sites=tuple(S.iupac_expand("NN")), check_site=True, internal_sites=("GGCC",), adapters=("ACGTTG",), adapter_rate=0.0, least_insert=3)
    out = demux.paired(f.mates, s, s)
    return _count(out, "f_dest", "r_dest", "f_ana", "r_ana")


_ADAPTER_SQL = f"coalesce(list_min(list_filter(range(0, 28), lambda p: list_sum(list_transform(range(1, least({len(ADAPTER)}, 32 - p) + 1), lambda k: CASE WHEN substr(seq, p + k, 1) = substr('{ADAPTER}', k, 1) THEN 0 ELSE 1 END)) <= floor(0.25::DOUBLE * least({len(ADAPTER)}, 32 - p)))), -1)::BIGINT"


def _bars(body) -> str:
    return " UNION ALL ".join(body(b) for b in BARCODES)


def _repair_sql(b_most: int, s_most: int) -> str:
    hits = _bars(lambda b: f"SELECT ind, o, i, tl, seq, '{b}' AS bc FROM v_raw WHERE {_mism('seq', b)} <= {b_most} AND {_mism(f'substr(seq, {len(b) + 1})', SITE)} <= {s_most}")
    return f"SELECT r.ind, r.o, r.i, r.tl, coalesce(h.bc, 'NN') AS barcode, CASE WHEN h.bc IS NULL THEN r.seq ELSE concat(h.bc, '{SITE}', substr(r.seq, length(h.bc) + 6)) END AS fixed FROM v_raw r LEFT JOIN (SELECT ind, o, i, tl, seq, min(bc) AS bc FROM (SELECT DISTINCT * FROM ({hits}) z) y GROUP BY ind, o, i, tl, seq HAVING count(*) = 1) h ON r.ind = h.ind AND r.o = h.o AND r.i = h.i AND r.tl = h.tl AND r.seq = h.seq"


_EXACT = " ".join(f"WHEN starts_with(seq, '{b + SITE}') THEN '{b}'" for b in BARCODES)
#: The tree of DEMUX: exact; site repair; barcode repair; clip; internal site; clip of the site.
_TREE = f"""t0 AS (SELECT *, CASE {_EXACT} END AS exact, {" || ".join(f"CASE WHEN starts_with(seq, '{b}') AND {_mism(f'substr(seq, {len(b) + 1})', SITE)} <= 1 THEN '{b},' ELSE '' END" for b in BARCODES)} AS s_hits, {" || ".join(f"CASE WHEN {_mism('seq', b)} <= 1 AND substr(seq, {len(b) + 1}, 5) = '{SITE}' THEN '{b},' ELSE '' END" for b in BARCODES)} AS b_hits FROM v_raw),
t1 AS (SELECT *, CASE WHEN exact IS NULL AND length(s_hits) - length(replace(s_hits, ',', '')) = 1 THEN replace(s_hits, ',', '') END AS s_fix, CASE WHEN exact IS NULL AND length(b_hits) - length(replace(b_hits, ',', '')) = 1 THEN replace(b_hits, ',', '') END AS b_fix FROM t0),
t2 AS (SELECT *, coalesce(exact, s_fix, b_fix) AS bar, CASE WHEN exact IS NOT NULL THEN 'clean' WHEN s_fix IS NOT NULL THEN 'bcr_c_fail_bc_rrep' WHEN b_fix IS NOT NULL THEN 'bcr_c_fail_bc_rrep_fail_bcrep_r' ELSE 'bcr_c_fail_bc_rrep_fail_bcrep_r_fail' END AS ana0 FROM t1),
t3 AS (SELECT *, concat('{SITE}', substr(seq, length(bar) + 6)) AS cut FROM t2),
t4 AS (SELECT ind, o, i, tl, CASE WHEN bar IS NULL THEN 'NN' WHEN contains(cut, 'TTAAC') THEN 'NN' ELSE bar END AS dest, CASE WHEN bar IS NOT NULL AND contains(cut, 'TTAAC') THEN ana0 || '_rint' ELSE ana0 END AS ana, CASE WHEN bar IS NULL OR contains(cut, 'TTAAC') THEN 0 ELSE 1 END AS good, CASE WHEN bar IS NOT NULL AND contains(cut, 'TTAAC') THEN 'rint' ELSE '' END AS override, CASE WHEN bar IS NULL THEN seq WHEN contains(cut, 'TTAAC') THEN cut ELSE substr(substr(cut, 6), 1, 28) END AS seq FROM t3)"""

#: The tree of ``fdm_pair`` for one mate, and the table of pairs.
_MATE = "CASE WHEN NOT regexp_matches({s}, '^[ACGT][ACGT]') THEN 'r1_c_fail' WHEN contains({s}, 'GGCC') THEN 'clean_rint' WHEN {a} < 5 THEN 'clean_ads' WHEN {a} IS NOT NULL THEN 'clean_ad' ELSE 'clean' END"
_START = "list_min(list_filter(range(0, 12), lambda p: starts_with('ACGTTG', substr({s}, p + 1, 6))))"
_PAIR = f"""m AS (SELECT {_MATE.format(s="f_seq", a=_START.format(s="f_seq"))} AS f, {_MATE.format(s="r_seq", a=_START.format(s="r_seq"))} AS r FROM v_mates),
g AS (SELECT *, f IN ('clean', 'clean_ad') AS fg, r IN ('clean', 'clean_ad') AS rg, f IN ('clean_rint', 'clean_ads') AS fx, r IN ('clean_rint', 'clean_ads') AS rx FROM m)
SELECT CASE WHEN fx OR rx OR NOT fg THEN 'NN' WHEN rg THEN 'SAMP' ELSE 'SAMP_sg' END AS f_dest, CASE WHEN fx OR rx OR NOT rg THEN 'NN' WHEN fg THEN 'SAMP' ELSE 'SAMP_sg' END AS r_dest,
f AS f_ana, CASE f WHEN 'clean_rint' THEN 'rint_pair' WHEN 'clean_ads' THEN 'ads_pair' ELSE r END AS r_ana, count(*) AS n FROM g GROUP BY ALL"""

_KEYS = "ind, o, i, tl"
_SITE4 = S.iupac_expand("GRTC")

QUERIES = {
    "revcomp": (revcomp, f"SELECT {_KEYS}, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM v_reads"),
    "seq_length": (seq_length, "SELECT ind, length(seq)::INT AS sl, count(*) AS n FROM v_raw GROUP BY ALL"),
    "n_expand": (n_expand, "SELECT ind, CASE WHEN b IS NULL THEN seq ELSE replace(seq, 'N', b) END AS seq, count(*) AS n FROM v_reads LEFT JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(b) ON contains(seq, 'N') GROUP BY ALL"),
    "mismatch_prefix": (mismatch_prefix, f"SELECT {_KEYS}, {_mism('seq', 'ACGTGATCC')}::BIGINT AS wrong FROM v_raw"),
    "hamming": (hamming, f"SELECT {_KEYS}, hamming(seq, translate(reverse(seq), 'ACGT', 'TGCA'))::BIGINT AS dist FROM v_reads"),
    "hamming_ignore_n": (hamming_ignore_n, f"SELECT {_KEYS}, list_sum(list_transform(range(1, 33), lambda p: CASE WHEN substr(seq, p, 1) = substr(rc, p, 1) OR substr(seq, p, 1) = 'N' OR substr(rc, p, 1) = 'N' THEN 0 ELSE 1 END))::BIGINT AS dist FROM (SELECT *, translate(reverse(seq), 'ACGT', 'TGCA') AS rc FROM v_reads) x"),
    "simplify_header": (simplify_header, f"SELECT {_KEYS}, concat('@', o, '_', i, '_', tl, '_9_1') AS header FROM v_reads"),
    "sliding_quality": (sliding_quality, f"SELECT {_KEYS}, CASE WHEN list_min(list_transform(range(1, 29), lambda p: ascii(substr(qual, p, 1)) + ascii(substr(qual, p + 1, 1)) + ascii(substr(qual, p + 2, 1)) + ascii(substr(qual, p + 3, 1)) + ascii(substr(qual, p + 4, 1)))) < 265 THEN 0 ELSE 1 END::INT AS good FROM v_reads"),
    "trunc_to": (trunc_to, f"SELECT {_KEYS}, substr(seq, 1, 20) AS seq, substr(qual, 1, 20) AS qual FROM v_reads"),
    "site_starts": (site_starts, f"SELECT {_KEYS}, regexp_matches(seq, '^[AG][CT][ACGT]')::INT AS starts FROM v_reads"),
    "site_repair": (site_repair, f"SELECT {_KEYS}, CASE WHEN {_mism('seq', _SITE4[0])} <= {_mism('seq', _SITE4[1])} THEN CASE WHEN {_mism('seq', _SITE4[0])} <= 2 THEN concat('{_SITE4[0]}', substr(seq, 5)) END WHEN {_mism('seq', _SITE4[1])} <= 2 THEN concat('{_SITE4[1]}', substr(seq, 5)) END AS fixed FROM v_reads"),
    "barcode_match": (barcode_match, f"SELECT {_KEYS}, coalesce(CASE {_EXACT} END, 'NN') AS barcode FROM v_raw"),
    "barcode_site_repair": (lambda f: _repair(f, 0, 1), _repair_sql(0, 1)),
    "barcode_repair": (lambda f: _repair(f, 1, 0), _repair_sql(1, 0)),
    "barcode_both_repair": (lambda f: _repair(f, 1, 1), _repair_sql(1, 1)),
    "clip_prefix": (clip_prefix, f"SELECT {_KEYS}, CASE WHEN regexp_matches(seq, '^[AG]C') THEN substr(seq, 3) END AS clipped, regexp_matches(seq, '^[AG]C')::INT AS ok FROM v_reads"),
    "compensate_barcode_len": (compensate_barcode_len, f"SELECT {_KEYS}, substr(seq, length(bc) + 1, length(seq) - 6) AS seq FROM (SELECT *, CASE {_EXACT} END AS bc FROM v_raw) x WHERE bc IS NOT NULL"),
    "internal_site": (internal_site, f"SELECT {_KEYS}, (contains(seq, 'GATC') OR contains(seq, 'TTAA'))::INT AS inside FROM v_reads"),
    "find_adapter": (find_adapter, f"SELECT {_KEYS}, {_ADAPTER_SQL} AS start FROM v_reads"),
    "dup_revcomp_pair": (dup_revcomp_pair, f"SELECT {_KEYS}, translate(reverse(f_seq), 'ACGT', 'TGCA') AS r_seq, reverse(f_qual) AS r_qual FROM v_mates"),
    "concat_revcomp_pair": (concat_revcomp_pair, f"SELECT {_KEYS}, x AS f_seq, translate(reverse(x), 'ACGT', 'TGCA') AS r_seq FROM (SELECT *, concat(substr(f_seq, 1, 14), translate(reverse(substr(r_seq, 1, 14)), 'ACGT', 'TGCA')) AS x FROM v_mates) y"),
    "split_fragments": (split_fragments, "SELECT k::BIGINT AS k, CASE WHEN k = 4 THEN substr(seq, 25) ELSE substr(seq, (k * 6 + 1)::INT, 6) END AS fragment, count(*) AS n FROM v_reads, range(0, 5) t(k) GROUP BY ALL"),
    "half_overlaps": (half_overlaps, "SELECT q::BIGINT AS overlap, count(*) AS n FROM v_reads, range(0, 9) t(q) WHERE q = 0 OR (q >= 2 AND substr(seq, (17 - q)::INT, q::INT) = substr(seq, 17, q::INT)) GROUP BY ALL"),
    "iupac_expand": (iupac_expand, "pt AS (SELECT DISTINCT concat('RY', substr(seq, 1, 6)) AS pattern FROM v_reads), ex AS (SELECT pattern, 0 AS p, '' AS variant FROM pt UNION ALL SELECT pattern, p + 1, variant || b FROM ex, LATERAL (SELECT unnest(string_split(CASE substr(pattern, p + 1, 1) WHEN 'R' THEN 'A,G' WHEN 'Y' THEN 'C,T' WHEN 'N' THEN 'A,C,G,T' ELSE substr(pattern, p + 1, 1) END, ',')) AS b) u WHERE p < 8) SELECT pattern, (row_number() OVER (PARTITION BY pattern ORDER BY variant) - 1)::BIGINT AS k, variant FROM ex WHERE p = 8"),
    "phred_histogram": (phred_histogram, "SELECT ind, p::BIGINT AS pos, (ascii(substr(qual, p::INT, 1)) - 33)::BIGINT AS score, round(100.0::DOUBLE * count(*) / max(total), 6) AS perc FROM (SELECT *, count(*) OVER (PARTITION BY ind) AS total FROM v_reads) x, range(1, 33) t(p) GROUP BY ALL"),
    "phred_pos_filter": (phred_pos_filter, "SELECT ind, count(*) AS n FROM v_reads WHERE ascii(substr(qual, 1, 1)) >= 53 AND ascii(substr(qual, 5, 1)) >= 48 AND ascii(substr(qual, 32, 1)) >= 47 GROUP BY ind"),
    "phred_pos_filter_pair": (phred_pos_filter_pair, "SELECT ind, count(*) AS n FROM v_mates WHERE ascii(substr(f_qual, 1, 1)) >= 53 AND ascii(substr(f_qual, 3, 1)) >= 51 AND ascii(substr(r_qual, 2, 1)) >= 49 GROUP BY ind"),
    "phred_filter_report": (phred_filter_report, "SELECT ind, count(*) AS n_seq, (count(*) FILTER (WHERE NOT ok)) AS n_bad, round((count(*) FILTER (WHERE NOT ok))::DOUBLE / count(*), 6) AS prop_bad, (count(*) FILTER (WHERE ok)) AS n_good FROM (SELECT ind, ascii(substr(qual, 1, 1)) >= 53 AND ascii(substr(qual, 5, 1)) >= 48 AND ascii(substr(qual, 32, 1)) >= 47 AS ok FROM v_reads) x GROUP BY ind"),
    "fdm_tree": (fdm_tree, f"{_TREE} SELECT {_KEYS}, dest, ana, good, override FROM t4"),
    "fdm_single": (fdm_single, f"{_TREE} SELECT {_KEYS}, dest, ana, seq FROM t4"),
    "fdm_report": (fdm_report, f"{_TREE} SELECT dest, ana, count(*) AS n FROM t4 GROUP BY ALL"),
    "fdm_demux": (fdm_demux, f"{_TREE} SELECT dest, concat('@r_', ind, '_', o, '_', i, '_', tl) AS header, seq, count(*) AS n FROM t4 WHERE dest != 'NN' GROUP BY ALL"),
    "fdm_pair": (fdm_pair, _PAIR),
}
