"""Queries on individual loci: similarity, components, SNP and allele calling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.operators import database
from locuspark.operators import individual as I
from locuspark.operators.similarity import similar_pairs as pairs_within
from locuspark.plans.scratch import materialize, scratch_dir
from locuspark.queries.fixtures import Fixture

GOOD, HAP, RARE = 4, 4, 6


def _svars(f: Fixture) -> DataFrame:
    return f.stage("svars", lambda: I.svar_count(f.reads))


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else F.col(c) for c in df.columns])


def used(f: Fixture) -> DataFrame:
    """Svars of loci of every individual; written once for each set of tables."""
    return f.stage("used", lambda: I.loci_of(_svars(f), GOOD, HAP, RARE))


def svar_count(f: Fixture) -> DataFrame:
    return _long(_svars(f), "sl")


def svar_count_rc(f: Fixture) -> DataFrame:
    return _long(I.svar_count_rc(f.reads), "sl")


def svar_split_good_rare(f: Fixture) -> DataFrame:
    return _svars(f).groupBy("ind").agg(F.count_if(F.col("depth") >= GOOD).alias("n_good"), F.count_if(F.col("depth") < GOOD).alias("n_rare"))


def dist_asof(f: Fixture) -> DataFrame:
    lengths = f.raw.select("ind", F.length("seq").alias("sl")).distinct()
    return _long(I.dist_asof(lengths, [(39, 3), (42, 5), (50, 9)], ["ind"]), "sl", "dist")


def fragment_catalog(f: Fixture) -> DataFrame:
    pieces = _svars(f).select("ind", "seq", F.posexplode(S.fragments(F.col("seq"), F.lit(HAP))).alias("k", "fragment"))
    return _long(pieces.select("ind", "k", F.explode(S.n_expand(F.col("fragment"))).alias("piece")).groupBy("ind", "k", "piece").agg(F.count(F.lit(1)).alias("n")), "k")


def similar_pairs(f: Fixture) -> DataFrame:
    good = _svars(f).filter(F.col("depth") >= GOOD)
    return _long(pairs_within(good, ["ind"], "seq", HAP, ignore_n=True), "sl", "dist")


def locus_components(f: Fixture) -> DataFrame:
    good = _svars(f).filter(F.col("depth") >= GOOD)
    return I.locus_components(good, pairs_within(good, ["ind"], "seq", HAP, ignore_n=True)).select("ind", "seq", "depth", "first")


def rare_assign(f: Fixture) -> DataFrame:
    return used(f).filter("not good").select("ind", "loc", "seq", "depth")


def locus_depth(f: Fixture) -> DataFrame:
    return I.locus_depth(used(f)).select("ind", "loc", "loc_dep")


def snp_call_freq(f: Fixture) -> DataFrame:
    return I.snp_call_freq(used(f), 0.2).select("ind", "loc", "seq", "corrected")


def snp_call_binom(f: Fixture) -> DataFrame:
    return I.snp_call_binom(used(f), 0.01).select("ind", "loc", "seq", "corrected")


def _alleles(f: Fixture, binom: bool) -> tuple[DataFrame, DataFrame]:
    corrected = I.snp_call_binom(used(f)) if binom else I.snp_call_freq(used(f))
    return I.alleles(I.groups_of(corrected, binom), binom=binom)


def core_slice(f: Fixture) -> DataFrame:
    """Reads to individual alleles, by frequency."""
    return _alleles(f, False)[1].withColumn("depth", F.round("depth", 6))


def call_locus_freq(f: Fixture) -> DataFrame:
    return _long(_alleles(f, False)[0], "sl", "lost_alleles", "potlostmore")


def call_locus_binom(f: Fixture) -> DataFrame:
    return _long(_alleles(f, True)[0], "sl", "lost_alleles", "potlostmore")


def alleles_freq(f: Fixture) -> DataFrame:
    """Alleles of all loci, by frequency."""
    return _long(_alleles(f, False)[1].select("ind", "loc", "all_id", "seq", F.round("depth", 6).alias("depth")), "all_id")


def alleles_binom(f: Fixture) -> DataFrame:
    """The same by likelihood ratio."""
    return _long(_alleles(f, True)[1].select("ind", "loc", "all_id", "seq", F.round("depth", 6).alias("depth")), "all_id")


def svar_groups(binom: bool):
    def run(f: Fixture) -> DataFrame:
        c = I.snp_call_binom(used(f)) if binom else I.snp_call_freq(used(f))
        return I.groups_of(c, binom).select("ind", "loc", "seq", F.round("depth", 6).alias("depth"), "lost", "more")

    return run


def svar_groups_uncorrected(binom: bool):
    """Groups of the svars as they were read: reads with N link svars that differ, so most rules of groups are met."""

    def run(f: Fixture) -> DataFrame:
        return I.groups_of(I.snp_call_freq(used(f), -1), binom).select("ind", "loc", "seq", F.round("depth", 6).alias("depth"), "lost", "more")

    return run


def call_locus_uncorrected(f: Fixture) -> DataFrame:
    """Loci called without correction of svars."""
    return _long(I.alleles(I.groups_of(I.snp_call_freq(used(f), -1)))[0], "sl", "lost_alleles", "potlostmore")


def locus_min_depth(f: Fixture) -> DataFrame:
    """Loci by whether they reach the least depth, and those lost for it, which count one lost allele each."""
    loci = I.alleles(I.groups_of(I.snp_call_freq(used(f))), min_depth=30)[0].withColumn("shallow", F.col("loc_dep") < 30)
    lost = F.when(F.col("shallow") & (F.col("cat") == "lost") & (F.col("n_alleles") == 0), F.col("lost_alleles") * F.col("potlostmore")).otherwise(0)
    return loci.groupBy("shallow").agg(F.count(F.lit(1)).alias("n"), F.sum("loc_dep").cast("long").alias("depth"), F.sum(lost).cast("long").alias("n_lost"))


def single_svar_locus(f: Fixture) -> DataFrame:
    u = used(f)
    one = u.groupBy("ind", "loc").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.sum("depth").alias("depth")).filter("n = 1")
    return one.select("ind", "loc", F.when(F.col("seq").contains("N"), 0).otherwise(1).alias("n_alleles"), "depth")


def consensus_n_resolve(f: Fixture) -> DataFrame:
    per = used(f).groupBy("ind", "loc").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    return per.select("ind", "loc", S.consensus_n_resolve(F.col("seqs")).alias("cons"))


def var_positions(f: Fixture) -> DataFrame:
    per = used(f).groupBy("ind", "loc").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    return per.select("ind", "loc", S.varpos_text(S.var_positions(F.col("seqs"))).alias("varpos"))


def reads_annotate(f: Fixture) -> DataFrame:
    info = used(f).select("ind", "seq", "loc", "good")
    return I.reads_annotate(f.reads, info).groupBy("ind", "loc", "good").agg(F.count(F.lit(1)).alias("n_reads"), F.min("read_no").alias("first_read"))


def reads_annotate_rc(f: Fixture) -> DataFrame:
    """Reads and their reverse complements by the svars of either strand."""
    info = used(f).select("ind", "seq", "loc", "good")
    back = info.select("ind", S.revcomp(F.col("seq")).alias("seq"), (F.col("loc") + 1000).alias("loc"), "good").filter("ind % 3 <> 0")
    header = F.concat_ws("_", F.lit("@L"), "ind", "o", "i", F.lit("1"))
    rows = I.reads_annotate(f.reads.withColumn("header", header), info.unionByName(back), both_strands=True)
    return rows.select("ind", "loc", "good", "strand", I.mate_header(F.col("header"), F.col("mate")).alias("header")).groupBy("ind", "loc", "good", "strand").agg(F.count(F.lit(1)).alias("n_reads"), F.min("header").alias("first_header"), F.max("header").alias("last_header"))


def _called(reads: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run over reads."""
    svars = materialize(I.loci_of(I.svar_count(reads), GOOD, HAP, RARE))
    loci, alleles = I.alleles(materialize(I.groups_of(I.snp_call_freq(svars))))
    return {"svars": svars, "alleles": alleles, "loci": loci}


def ind_status(f: Fixture) -> DataFrame:
    """A database after two runs, the second one done twice: some individuals have unusable reads, some none of enough depth."""
    reads = f.reads.select("ind", F.when((F.col("ind") % 13 == 5) & (F.col("o") % 5 == 0), F.translate("seq", "A", "X")).otherwise(F.col("seq")).alias("seq"))
    reads = reads.filter("ind % 17 <> 3").unionByName(f.reads.filter("ind % 17 = 3").select("ind", F.concat("seq", F.lpad(F.translate(F.conv((8 * F.col("o") + F.col("i")).cast("string"), 10, 4), "0123", "ACGT"), 12, "A")).alias("seq")))
    path = f"{scratch_dir(f.spark)}/{uuid.uuid4().hex}"
    for batch, rest in (("first", 0), ("second", 1), ("second", 1)):
        own = reads.filter(F.col("ind") % 2 == rest)
        listed = own.select("ind").distinct()
        if batch == "second":
            listed = listed.unionByName(listed.select((-F.col("ind")).alias("ind")).filter("ind % 7 = 0"))
        database.append(path, batch, own, listed, _called)
    return database.status(f.spark, path).select("ind", "batch", "success", "reason", "n_loci")


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 33), lambda p: CASE WHEN substr({a}, p, 1) = substr({b}, p, 1) OR substr({a}, p, 1) = 'N' OR substr({b}, p, 1) = 'N' THEN 0 ELSE 1 END))"


_SV = "sv AS (SELECT ind, seq, count(*) AS depth FROM v_reads GROUP BY ind, seq)"
_GOOD = f"{_SV}, good AS (SELECT * FROM sv WHERE depth >= {GOOD}), rare AS (SELECT * FROM sv WHERE depth < {GOOD})"
_PAIRS = f"{_GOOD}, prs AS (SELECT a.ind, a.seq AS seq1, b.seq AS seq2, {_dist('a.seq', 'b.seq')}::BIGINT AS dist FROM good a JOIN good b ON a.ind = b.ind AND a.seq < b.seq WHERE {_dist('a.seq', 'b.seq')} <= {HAP})"
_CC = f"{_PAIRS}, e AS (SELECT ind, seq1 AS x, seq2 AS y FROM prs UNION ALL SELECT ind, seq2, seq1 FROM prs), walk AS (SELECT ind, seq, seq AS r FROM good UNION SELECT w.ind, w.seq, e.y FROM walk w JOIN e ON w.ind = e.ind AND w.r = e.x), comp AS (SELECT ind, seq, min(r) AS first FROM walk GROUP BY ind, seq), loci AS (SELECT c.ind, c.seq, g.depth, c.first, dense_rank() OVER (PARTITION BY c.ind ORDER BY c.first)::BIGINT AS loc FROM comp c JOIN good g ON c.ind = g.ind AND c.seq = g.seq)"
_USED = f"{_CC}, near AS (SELECT r.ind, r.seq, r.depth, count(DISTINCT l.loc) AS k, min(l.loc) AS loc FROM rare r JOIN loci l ON r.ind = l.ind WHERE {_dist('r.seq', 'l.seq')} <= {RARE} GROUP BY ALL), used AS (SELECT ind, loc, seq, depth, true AS good FROM loci UNION ALL SELECT ind, loc, seq, depth, false FROM near WHERE k = 1)"
_COL = f"{_USED}, dep AS (SELECT ind, loc, sum(depth)::BIGINT AS loc_dep FROM used GROUP BY ALL), colb AS (SELECT ind, loc, p, substr(seq, p, 1) AS b, sum(depth)::BIGINT AS d FROM used, (SELECT unnest(range(1, 33))::INT AS p) t GROUP BY ALL)"


def _call(least: str) -> str:
    return f"""{_COL}, lim AS (SELECT c.ind, c.loc, c.p, any_value(loc_dep) AS loc_dep, count(*) AS kinds, count(*) FILTER (WHERE b != 'N') AS bases, coalesce(max(d) FILTER (WHERE b != 'N'), 0) AS n1, coalesce(list_sort(list(d) FILTER (WHERE b != 'N'), 'DESC')[2], 0) AS n2 FROM colb c JOIN dep ON c.ind = dep.ind AND c.loc = dep.loc GROUP BY c.ind, c.loc, c.p),
lim2 AS (SELECT *, {least} AS minrd FROM lim),
st AS (SELECT c.ind, c.loc, c.p, any_value(kinds) AS kinds, any_value(bases) AS bases, any_value(minrd) AS minrd, count(*) FILTER (WHERE b != 'N' AND d >= minrd) AS n_good, min(b) FILTER (WHERE b != 'N' AND d >= minrd) AS only_b, count(*) FILTER (WHERE b = 'N' OR d < minrd) AS n_bad FROM colb c JOIN lim2 l ON c.ind = l.ind AND c.loc = l.loc AND c.p = l.p GROUP BY c.ind, c.loc, c.p),
cor AS (SELECT u.ind, u.loc, u.seq, any_value(u.depth) AS depth, string_agg(CASE WHEN kinds < 2 OR bases = 0 OR n_bad = 0 THEN c.b WHEN n_good = 1 THEN only_b WHEN n_good = 0 THEN 'N' WHEN c.b != 'N' AND c.d >= minrd THEN c.b ELSE 'N' END, '' ORDER BY st.p) AS corrected FROM used u JOIN st ON u.ind = st.ind AND u.loc = st.loc JOIN colb c ON c.ind = st.ind AND c.loc = st.loc AND c.p = st.p AND c.b = substr(u.seq, st.p, 1) GROUP BY u.ind, u.loc, u.seq)"""


_FREQ = _call("floor(loc_dep * 0.2::DOUBLE)")
_BINOM = _call("CASE WHEN bases < 2 THEN 0 ELSE greatest(floor(n1 * ln(0.99::DOUBLE / 0.5) / ln(0.5::DOUBLE / 0.01) + 1), n2) END")


def _groups(call: str, gift: str) -> str:
    """``call`` and the groups of compatible svars: ``grp`` (ind, loc, seq, depth) and ``ls`` (ind, loc, lost, more)."""
    return f"""{call},
hs AS (SELECT ind, loc, corrected AS seq, sum(depth)::DOUBLE AS depth, count(*) AS k, contains(corrected, 'N') AS n FROM cor GROUP BY ALL),
ed AS (SELECT a.ind, a.loc, a.seq AS x, b.seq AS y FROM hs a JOIN hs b ON a.ind = b.ind AND a.loc = b.loc AND a.seq <> b.seq WHERE (a.n OR b.n) AND {_dist('a.seq', 'b.seq')} = 0),
wk AS (SELECT ind, loc, seq, seq AS r FROM hs UNION SELECT w.ind, w.loc, w.seq, e.y FROM wk w JOIN ed e ON w.ind = e.ind AND w.loc = e.loc AND w.r = e.x),
cp AS (SELECT ind, loc, seq, min(r) AS c, count(*) AS size FROM wk GROUP BY ind, loc, seq),
dg AS (SELECT ind, loc, x AS seq, count(*) AS deg FROM ed GROUP BY ALL),
nd AS (SELECT hs.*, c, coalesce(deg, 0) = size - 1 AS full_deg FROM hs JOIN cp USING (ind, loc, seq) LEFT JOIN dg USING (ind, loc, seq)),
cl AS (SELECT ind, loc, c, bool_and(full_deg) AS clique, coalesce(sum(k) FILTER (n), 0) AS n_out, coalesce(sum(k) FILTER (NOT n), 0) AS n_stay FROM nd GROUP BY ALL),
mx AS (SELECT nd.*, n_out, n_stay FROM nd JOIN cl USING (ind, loc, c) WHERE NOT clique),
pr AS (SELECT a.ind, a.loc, a.seq AS x, b.seq AS y, a.depth AS dx, b.depth AS dy, b.k AS ky, b.n AS ny FROM ed JOIN mx a ON a.ind = ed.ind AND a.loc = ed.loc AND a.seq = ed.x AND a.n JOIN mx b ON b.ind = ed.ind AND b.loc = ed.loc AND b.seq = ed.y),
rc AS (SELECT ind, loc, x AS seq, sum(dy) AS rd, sum(ky) AS rk FROM pr WHERE NOT ny GROUP BY ALL),
rl AS (SELECT mx.*, rd, rk, CASE WHEN NOT n THEN 's' WHEN rk IS NOT NULL THEN 'd' ELSE 'o' END AS role FROM mx LEFT JOIN rc USING (ind, loc, seq)),
bs AS (SELECT pr.ind, pr.loc, x AS seq, sum(dy) AS bd, sum(ky) AS bk FROM pr JOIN rl ON rl.ind = pr.ind AND rl.loc = pr.loc AND rl.seq = pr.y AND role = 'o' GROUP BY ALL),
gv AS (SELECT pr.ind, pr.loc, y AS seq, sum({gift}) AS given FROM pr JOIN rl d ON d.ind = pr.ind AND d.loc = pr.loc AND d.seq = pr.x AND d.role = 'd' LEFT JOIN bs ON bs.ind = pr.ind AND bs.loc = pr.loc AND bs.seq = pr.x WHERE NOT ny GROUP BY ALL),
ls AS (SELECT ind, loc, sum(lost)::INT AS lost, max(more)::INT AS more FROM (SELECT ind, loc, c, CASE WHEN any_value(n_stay) = 0 THEN 2 WHEN any_value(n_stay) = 1 OR count(*) FILTER (role = 'o') > 0 THEN 1 ELSE 0 END AS lost, CASE WHEN any_value(n_stay) = 0 THEN any_value(n_out) > 2 WHEN any_value(n_stay) = 1 OR count(*) FILTER (role = 'o') > 0 THEN any_value(n_out) > 1 ELSE count(*) FILTER (role = 'd') > 0 END::INT AS more FROM rl GROUP BY ind, loc, c) q GROUP BY ind, loc),
cs AS (SELECT ind, loc, c, string_agg(b, '' ORDER BY p) AS seq FROM (SELECT ind, loc, c, p, coalesce(max(substr(seq, p, 1)) FILTER (substr(seq, p, 1) <> 'N'), 'N') AS b FROM nd JOIN cl USING (ind, loc, c), (SELECT unnest(range(1, 33))::INT AS p) t WHERE clique GROUP BY ALL) q GROUP BY ALL),
g1 AS (SELECT ind, loc, cs.seq, sum(depth) AS depth FROM cs JOIN nd USING (ind, loc, c) GROUP BY ind, loc, c, cs.seq UNION ALL SELECT ind, loc, seq, depth + coalesce(given, 0) FROM rl LEFT JOIN gv USING (ind, loc, seq) WHERE role = 's'),
grp AS (SELECT d.ind, d.loc, loc_dep, seq, depth, coalesce(lost, 0) AS lost, coalesce(more, 0) AS more FROM dep d LEFT JOIN g1 USING (ind, loc) LEFT JOIN ls USING (ind, loc))"""


_GROUPS = {False: _groups(_FREQ, "dx * dy / (rd + coalesce(bd, 0))"), True: _groups(_BINOM, "CASE WHEN rk + coalesce(bk, 0) = 1 THEN dx ELSE 0 END")}
_RAW = {binom: _groups(f"{_COL}, cor AS (SELECT ind, loc, seq, depth, seq AS corrected FROM used)", gift) for binom, gift in {False: "dx * dy / (rd + coalesce(bd, 0))", True: "CASE WHEN rk + coalesce(bk, 0) = 1 THEN dx ELSE 0 END"}.items()}
_OK = {
    False: "al AS (SELECT *, seq IS NOT NULL AND NOT contains(seq, 'N') AND depth >= floor(loc_dep * 0.2::DOUBLE) AS ok FROM grp)",
    True: "sn AS (SELECT ind, loc, coalesce(list_sort(list(depth), 'DESC')[2], 0) AS second FROM grp WHERE seq IS NOT NULL AND NOT contains(seq, 'N') GROUP BY ALL), al AS (SELECT grp.*, seq IS NOT NULL AND NOT contains(seq, 'N') AND depth >= coalesce(second, 0) AS ok FROM grp LEFT JOIN sn USING (ind, loc))",
}


def _alleles_sql(binom: bool, more: str = "") -> str:
    return f"{_GROUPS[binom]}, {_OK[binom]} SELECT ind, loc, {more}row_number() OVER (PARTITION BY ind, loc ORDER BY seq)::BIGINT AS all_id, seq, round(depth, 6) AS depth FROM al WHERE ok"


def _groups_sql(base: str) -> str:
    return f"{base} SELECT ind, loc, seq, round(depth, 6) AS depth, lost::INT AS lost, more::INT AS more FROM grp"


def _loci_sql(base: str, binom: bool) -> str:
    n = "(count(*) FILTER (ok))"
    return f"{base}, {_OK[binom]} SELECT ind, loc, CASE WHEN {n} > 0 THEN 'valid' ELSE 'lost' END AS cat, 32::BIGINT AS sl, any_value(loc_dep) AS loc_dep, {n} AS n_alleles, (max(lost) + count(*) FILTER (seq IS NOT NULL AND NOT ok))::BIGINT AS lost_alleles, max(more)::BIGINT AS potlostmore FROM al GROUP BY ind, loc"


QUERIES = {
    "svar_count": (svar_count, "SELECT ind, length(seq)::BIGINT AS sl, seq, count(*) AS depth FROM v_reads GROUP BY ALL"),
    "svar_count_rc": (svar_count_rc, "SELECT ind, length(seq)::BIGINT AS sl, seq, count(*) AS depth FROM (SELECT ind, seq FROM v_reads UNION ALL SELECT ind, translate(reverse(seq), 'ACGT', 'TGCA') FROM v_reads) x GROUP BY ALL"),
    "svar_split_good_rare": (svar_split_good_rare, f"{_SV} SELECT ind, count(*) FILTER (WHERE depth >= {GOOD}) AS n_good, count(*) FILTER (WHERE depth < {GOOD}) AS n_rare FROM sv GROUP BY ind"),
    "dist_asof": (dist_asof, "ln AS (SELECT DISTINCT ind, length(seq) AS sl FROM v_raw) SELECT ind, sl::BIGINT AS sl, coalesce(last_value(CASE sl WHEN 39 THEN 3 WHEN 42 THEN 5 WHEN 50 THEN 9 END IGNORE NULLS) OVER (PARTITION BY ind ORDER BY sl), 3)::BIGINT AS dist FROM ln"),
    "fragment_catalog": (fragment_catalog, f"{_SV}, fr AS (SELECT ind, k, CASE WHEN k = 4 THEN substr(seq, 25) ELSE substr(seq, (k * 6 + 1)::INT, 6) END AS fragment FROM sv, range(0, 5) t(k)) SELECT ind, k::BIGINT AS k, CASE WHEN b IS NULL THEN fragment ELSE replace(fragment, 'N', b) END AS piece, count(*) AS n FROM fr LEFT JOIN (VALUES ('A'), ('C'), ('G'), ('T')) v(b) ON contains(fragment, 'N') GROUP BY ALL"),
    "similar_pairs": (similar_pairs, f"{_PAIRS} SELECT ind, 32::BIGINT AS sl, seq1, seq2, dist FROM prs"),
    "locus_components": (locus_components, f"{_CC} SELECT ind, seq, depth, first FROM loci"),
    "rare_assign": (rare_assign, f"{_USED} SELECT ind, loc, seq, depth FROM used WHERE NOT good"),
    "locus_depth": (locus_depth, f"{_COL} SELECT ind, loc, loc_dep FROM dep"),
    "locus_min_depth": (locus_min_depth, f"{_COL} SELECT loc_dep < 30 AS shallow, count(*) AS n, sum(loc_dep)::BIGINT AS depth, (count(*) FILTER (WHERE loc_dep < 30))::BIGINT AS n_lost FROM dep GROUP BY loc_dep < 30"),
    "single_svar_locus": (single_svar_locus, f"{_USED} SELECT ind, loc, CASE WHEN contains(min(seq), 'N') THEN 0 ELSE 1 END::INT AS n_alleles, sum(depth)::BIGINT AS depth FROM used GROUP BY ind, loc HAVING count(*) = 1"),
    "snp_call_freq": (snp_call_freq, f"{_FREQ} SELECT ind, loc, seq, corrected FROM cor"),
    "snp_call_binom": (snp_call_binom, f"{_BINOM} SELECT ind, loc, seq, corrected FROM cor"),
    "svar_groups_freq": (svar_groups(False), _groups_sql(_GROUPS[False])),
    "svar_groups_binom": (svar_groups(True), _groups_sql(_GROUPS[True])),
    "alleles_freq": (alleles_freq, _alleles_sql(False)),
    "alleles_binom": (alleles_binom, _alleles_sql(True)),
    "call_locus_freq": (call_locus_freq, _loci_sql(_GROUPS[False], False)),
    "call_locus_binom": (call_locus_binom, _loci_sql(_GROUPS[True], True)),
    "svar_groups_uncorrected_freq": (svar_groups_uncorrected(False), _groups_sql(_RAW[False])),
    "svar_groups_uncorrected_binom": (svar_groups_uncorrected(True), _groups_sql(_RAW[True])),
    "call_locus_uncorrected": (call_locus_uncorrected, _loci_sql(_RAW[False], False)),
    "core_slice": (core_slice, _alleles_sql(False, "32::INT AS sl, ").replace("::BIGINT AS all_id", "::INT AS all_id")),
    "consensus_n_resolve": (consensus_n_resolve, f"{_COL} SELECT ind, loc, string_agg(b, '' ORDER BY p) AS cons FROM (SELECT ind, loc, p, coalesce(max(b) FILTER (WHERE b != 'N'), 'N') AS b FROM colb GROUP BY ALL) x GROUP BY ALL"),
    "var_positions": (var_positions, f"{_COL} SELECT ind, loc, coalesce('p:' || string_agg(p::VARCHAR, '/' ORDER BY p) FILTER (WHERE k > 1), 'NA') AS varpos FROM (SELECT ind, loc, p, count(*) AS k FROM colb GROUP BY ALL) x GROUP BY ALL"),
    "reads_annotate": (reads_annotate, f"{_USED} SELECT u.ind, loc, good, count(*) AS n_reads, min(read_no) AS first_read FROM v_reads r JOIN used u ON r.ind = u.ind AND r.seq = u.seq GROUP BY ALL"),
    "reads_annotate_rc": (reads_annotate_rc, f"{_USED}, sx AS (SELECT ind, seq, loc, good FROM used UNION ALL SELECT ind, translate(reverse(seq), 'ACGT', 'TGCA'), loc + 1000, good FROM used WHERE ind % 3 <> 0), both_ AS (SELECT ind, seq, 'f' AS strand, concat_ws('_', '@L', ind, o, i, 1) AS header FROM v_reads UNION ALL SELECT ind, translate(reverse(seq), 'ACGT', 'TGCA'), 'r', concat_ws('_', '@L', ind, o, i, 2) FROM v_reads) SELECT b.ind, loc, good, strand, count(*) AS n_reads, min(header) AS first_header, max(header) AS last_header FROM both_ b JOIN sx ON b.ind = sx.ind AND b.seq = sx.seq GROUP BY ALL"),
    "ind_status": (ind_status, f"{_USED}, st AS (SELECT ind, CASE WHEN ind % 2 = 0 THEN 'first' ELSE 'second' END AS batch, CASE WHEN bool_or(ind % 13 = 5 AND o % 5 = 0 AND ind % 17 <> 3 AND contains(seq, 'A')) THEN 'letters other than ACGTN' WHEN ind % 17 = 3 THEN 'no locus' END AS reason FROM v_reads GROUP BY ind UNION ALL SELECT DISTINCT -ind, 'second', 'no reads' FROM v_reads WHERE ind % 2 = 1 AND ind % 7 = 0), nl AS (SELECT ind, count(DISTINCT loc) AS n FROM used GROUP BY ind) SELECT st.ind, batch, (reason IS NULL)::INT AS success, reason, CASE WHEN reason IS NULL THEN n ELSE 0 END::BIGINT AS n_loci FROM st LEFT JOIN nl ON st.ind = nl.ind"),
}
