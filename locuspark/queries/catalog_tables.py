"""Queries on the population catalogue, pairs, depth, selection and export."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.operators import depth, export, pairs, population, selection
from locuspark.operators.selection import Selection
from locuspark.queries.fixtures import Fixture

D = 4
RANGES = [(1, 31), (32, 100)]
MSL, OVER = 32, (2, 8)


class Db:
    """Relations of a genotype database over the fixture."""

    def __init__(self, f: Fixture):
        self.f = f

    @cached_property
    def pool(self) -> DataFrame:
        return population.pool_alleles(self.f.alleles)

    @cached_property
    def popall(self) -> DataFrame:
        return self.f.stage("popall", lambda: population.with_popallvar(population.pop_loci(self.pool, D)))

    @cached_property
    def catalogue(self) -> DataFrame:
        return population.catalogue(self.popall)

    @cached_property
    def links(self) -> DataFrame:
        return self.f.stage("links", lambda: population.link_alleles(self.f.alleles, self.popall))

    @cached_property
    def loci_links(self) -> DataFrame:
        return population.link_loci(self.links)

    @cached_property
    def sel(self) -> Selection:
        return Selection.default(self.loci_links)

    @cached_property
    def facts(self) -> DataFrame:
        return self.f.stage("facts", lambda: selection.genotype_facts(self.links, self.loci_links, self.f.ind_loci))

    @cached_property
    def locus_facts(self) -> DataFrame:
        return selection.locus_facts(self.sel.gt, self.links, self.facts, self.popall)

    @cached_property
    def scaled(self) -> DataFrame:
        units = depth.cluster_units(self.catalogue)
        return depth.scaled(depth.unit_depth(self.loci_links, self.f.ind_loci, units), RANGES)

    @cached_property
    def seen(self) -> DataFrame:
        return export.gt_prune_alleles(self.links, self.sel.gt)


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers as long, other numbers rounded to six digits."""
    kinds = {"int": lambda c: F.col(c).cast("long").alias(c), "double": lambda c: F.round(c, 6).alias(c)}
    return df.select(*[kinds.get(k, F.col)(c) for c, k in df.dtypes])


def _q(run):
    return lambda f: _long(run(Db(f)))


def _pair_reads(db: Db) -> DataFrame:
    """The two mates of each key, as (ind, loc1, loc2)."""
    named = db.f.mate_reads.select("ind", pairs.pair_key("read_key").alias("pair_key"), F.col("loc").alias("poploc"))
    return db.f.stage("pair_reads", lambda: pairs.read_pair_join(named))


def _groups(db: Db) -> DataFrame:
    return db.f.stage("pair_groups", lambda: _new_groups(db))


def _new_groups(db: Db) -> DataFrame:
    linked = _pair_reads(db)
    return pairs.pair_groups(pairs.pair_counts(linked), db.f.mate_reads.select(F.col("loc").alias("poploc")))


def _clean(db: Db) -> tuple[DataFrame, DataFrame]:
    return pairs.poison_groups(_groups(db), pairs.self_match(_pair_reads(db)))


def _gt_where(column: str, test) -> object:
    return _q(lambda db: db.facts.filter(test(F.col(column))).select("poploc", "ind"))


_POOL = "pool AS (SELECT seq, length(seq) AS sl, count(*) AS n_founders FROM v_alleles GROUP BY seq)"
_PE = f"{_POOL}, pe AS (SELECT a.seq AS x, b.seq AS y FROM pool a JOIN pool b ON a.sl = b.sl AND a.seq != b.seq AND hamming(a.seq, b.seq) <= {D})"
_POP = f"{_PE}, pw AS (SELECT seq, seq AS r FROM pool UNION SELECT w.seq, e.y FROM pw w JOIN pe e ON w.r = e.x), pc AS (SELECT seq, min(r) AS first FROM pw GROUP BY seq), pa AS (SELECT dense_rank() OVER (ORDER BY first)::BIGINT AS poploc, dense_rank() OVER (ORDER BY seq)::BIGINT AS popall, seq, length(seq)::BIGINT AS sl FROM pc)"
_CODE = "CASE string_agg(b, '' ORDER BY b) " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in S.IUPAC.items() if k != "N") + " ELSE 'N' END"


def _cat(src: str, out: str) -> str:
    """Consensus, variable positions of the alleles of ``src`` (poploc, popall, seq)."""
    return f"{out}_b AS (SELECT poploc, p, substr(seq, p, 1) AS b FROM {src}, (SELECT unnest(range(1, 33))::INT AS p) t GROUP BY ALL), {out}_c AS (SELECT poploc, p, count(*) AS k, {_CODE} AS code FROM {out}_b GROUP BY ALL), {out} AS (SELECT poploc, string_agg(code, '' ORDER BY p) AS cons, count(*) FILTER (WHERE k > 1) AS n_snp, coalesce('p:' || string_agg(p::VARCHAR, '/' ORDER BY p) FILTER (WHERE k > 1), 'NA') AS varpos FROM {out}_c GROUP BY poploc)"


_CAT = f"{_POP}, {_cat('pa', 'ca')}"
_VAR = f"{_CAT}, pv AS (SELECT pa.poploc, popall, any_value(seq) AS seq, any_value(sl) AS sl, coalesce(string_agg(substr(seq, p, 1), '' ORDER BY p) FILTER (WHERE k > 1), 'consensus') AS popallvar FROM pa JOIN ca_c ON pa.poploc = ca_c.poploc GROUP BY pa.poploc, popall)"
_LINK = f"{_VAR}, lk AS (SELECT ind, loc, all_id, poploc, popall, popallvar, depth, pv.seq FROM v_alleles a JOIN pv ON a.seq = pv.seq), ll AS (SELECT DISTINCT ind, loc, poploc FROM lk), il AS (SELECT DISTINCT ind, loc, loc_dep FROM v_alleles), gt AS (SELECT DISTINCT poploc, ind FROM lk)"
_FACT = f"{_LINK}, fa AS (SELECT poploc, ind, sum(depth)::DOUBLE AS all_dep, count(DISTINCT (loc, all_id)) AS n_all, min(depth)::DOUBLE AS least_dep, count(DISTINCT loc) AS n_indloc FROM lk GROUP BY ALL), td AS (SELECT poploc, ll.ind, sum(loc_dep)::DOUBLE AS tot_dep FROM ll JOIN il ON ll.ind = il.ind AND ll.loc = il.loc GROUP BY ALL), fx AS (SELECT fa.*, tot_dep, CASE WHEN n_all = 1 THEN all_dep / 2 ELSE least_dep END AS minor_dep, all_dep / tot_dep AS frac_used FROM fa JOIN td ON fa.poploc = td.poploc AND fa.ind = td.ind)"
_LF = f"{_FACT}, lf AS (SELECT poploc, count(*) AS n_ind, max(n_all) AS n_all_ind, sum(n_indloc)::BIGINT AS n_indloc, min(frac_used) AS least_frac, (sum(n_indloc) > count(*))::BIGINT AS ties FROM fx GROUP BY poploc), nl AS (SELECT poploc, any_value(sl) AS sl, count(*) AS n_all FROM pv GROUP BY poploc)"
_MR = "mr AS (SELECT ind, pair_key, min(loc) AS loc1, max(loc) AS loc2, count(*) AS n FROM (SELECT ind, array_to_string(list_concat(string_split(read_key, '_')[1:4], string_split(read_key, '_')[6:]), '_') AS pair_key, loc FROM v_mate_reads) k GROUP BY ALL HAVING count(*) >= 2), pcn AS (SELECT loc1, loc2, count(*) AS n_seqpairs, count(DISTINCT ind) AS n_ind FROM mr WHERE loc1 != loc2 GROUP BY ALL), sm AS (SELECT loc1 AS poploc, count(*) AS n_seqpairs, count(DISTINCT ind) AS n_ind FROM mr WHERE loc1 = loc2 GROUP BY ALL)"
_PG = f"{_MR}, ge AS (SELECT loc1 AS x, loc2 AS y FROM pcn UNION ALL SELECT loc2, loc1 FROM pcn), gw AS (SELECT DISTINCT loc AS poploc, loc AS r FROM v_mate_reads UNION SELECT w.poploc, e.y FROM gw w JOIN ge e ON w.r = e.x), pg AS (SELECT poploc, min(r) AS first FROM gw GROUP BY poploc), bad AS (SELECT DISTINCT first FROM pg JOIN sm ON pg.poploc = sm.poploc)"
_UD = f"{_LINK}, ud AS (SELECT poploc AS unit, ll.ind, sum(loc_dep)::BIGINT AS dep FROM ll JOIN il ON ll.ind = il.ind AND ll.loc = il.loc GROUP BY ALL)"
_SC = f"{_UD}, sc AS (SELECT 1::BIGINT AS range_no, unit, ind, dep, (dep - min(dep) OVER w)::DOUBLE / nullif(max(dep) OVER w - min(dep) OVER w, 0) AS scaldep, 100 * (1 - cume_dist() OVER (PARTITION BY ind ORDER BY dep)) AS dep_perc FROM ud WINDOW w AS (PARTITION BY ind))"
_MMM = f"{_SC}, mm AS (SELECT range_no, unit, " + ", ".join(f"round({g}({c}), 6) AS {n}_{c}" for c in ("scaldep", "dep_perc") for n, g in (("min", "min"), ("med", "median"), ("max", "max"))) + " FROM sc GROUP BY ALL)"
_CELL = f"{_LINK}, c1 AS (SELECT poploc, ind, popallvar, max(depth) AS depth FROM lk GROUP BY ALL), ce AS (SELECT poploc, ind, string_agg(popallvar, '/' ORDER BY popallvar) AS alleles, string_agg(depth::VARCHAR, '/' ORDER BY popallvar) AS depths FROM c1 GROUP BY ALL)"
_SN = f"{_LINK}, lt AS (SELECT poploc, popall, p::BIGINT AS pos, substr(popallvar, (p + 1)::INT, 1) AS base FROM pv, range(0, 32) t(p) WHERE popallvar != 'consensus' AND p < length(popallvar)), vr AS (SELECT poploc, pos FROM lt GROUP BY ALL HAVING count(DISTINCT base) > 1), fs AS (SELECT lt.poploc, popall, lt.pos, base FROM lt JOIN (SELECT poploc, min(pos) AS pos FROM vr GROUP BY poploc) m ON lt.poploc = m.poploc AND lt.pos = m.pos), bn AS (SELECT poploc, base, row_number() OVER (PARTITION BY poploc ORDER BY n, base) - 1 AS bin, count(*) OVER (PARTITION BY poploc) AS k FROM (SELECT poploc, base, count(*) AS n FROM fs GROUP BY ALL) x), bi AS (SELECT fs.poploc, popall, fs.base, bin::BIGINT AS bin FROM fs JOIN bn ON fs.poploc = bn.poploc AND fs.base = bn.base WHERE k = 2)"
_DIP = f"{_LINK}, nm AS (SELECT poploc, popall, row_number() OVER (PARTITION BY poploc ORDER BY popall)::BIGINT AS allele_no FROM pa), di AS (SELECT lk.poploc, ind, min(allele_no) AS a1, max(allele_no) AS a2, count(DISTINCT allele_no) AS k FROM lk JOIN nm ON lk.poploc = nm.poploc AND lk.popall = nm.popall GROUP BY ALL)"
_SEQ = f"{_LINK}, sq AS (SELECT DISTINCT poploc, popall, ind, seq FROM lk), sc2 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY poploc, ind) = 1 THEN 2 ELSE 1 END::BIGINT AS n_copies FROM sq)"


def _two_at_most(db: Db) -> DataFrame:
    """Genotypes of at most two alleles; the rest an exporter rejects."""
    return db.facts.join(db.links.select("poploc", "ind", "popall").distinct().groupBy("poploc", "ind").count().filter("count <= 2"), ["poploc", "ind"], "left_semi").select("poploc", "ind")


def _wide(value: str):
    def run(db: Db) -> DataFrame:
        cells = export.genotype_cells(db.links, db.sel.gt)
        index = export.individual_index(db.sel.ind)
        # As cells again, so that the result's columns do not depend on the individuals: also shows the missing ones.
        return export.matrix_cells(export.matrix_rows(cells, value, index), index, value)

    return run


def _alignment(db: Db, kind: str) -> DataFrame:
    """Two sequences an individual: letters of the variable loci, or 0 and 1 of those with two bases."""
    if kind == "dna":
        shown = db.seen.filter("popallvar != 'consensus'").withColumnRenamed("popallvar", "part")
    else:
        shown = export.gt_biallelic(export.gt_first_snp(db.seen)).select("poploc", "popall", F.col("bin").alias("part"))
    loci = shown.groupBy("poploc").agg(F.max(F.length(F.col("part").cast("string"))).alias("len"))
    gt = _two_at_most(db)
    return export.alignment(export.phased(db.links, gt, shown, "part", seed=5), loci, gt, "N" if kind == "dna" else "-")


def _alignment_sql(shown: str, missing: str) -> str:
    swap = "substr(md5(concat_ws('|', 5, ind, poploc)), 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f')"
    return (
        f"ok AS (SELECT poploc, ind FROM lk GROUP BY ALL HAVING count(DISTINCT popall) <= 2), sh AS ({shown}), ln AS (SELECT poploc, max(length(part)) AS len FROM sh GROUP BY ALL), "
        f"ph AS (SELECT poploc, ind, CASE WHEN {swap} THEN list_reverse(v) ELSE v END AS v FROM (SELECT x.poploc, x.ind, list(part ORDER BY x.popall) AS v FROM (SELECT DISTINCT lk.poploc, lk.ind, lk.popall FROM lk JOIN ok USING (poploc, ind)) x JOIN sh USING (poploc, popall) GROUP BY ALL) y) "
        f"SELECT i.ind, c::BIGINT AS copy, string_agg(coalesce(CASE WHEN c = 1 THEN v[1] ELSE v[-1] END, repeat('{missing}', len::INT)), '' ORDER BY ln.poploc) AS seq FROM ln CROSS JOIN (SELECT DISTINCT ind FROM ok) i CROSS JOIN (VALUES (1), (2)) t(c) LEFT JOIN ph ON ph.poploc = ln.poploc AND ph.ind = i.ind GROUP BY i.ind, c"
    )


_SHOWN = "SELECT DISTINCT poploc, popall, popallvar AS part FROM lk WHERE popallvar <> 'consensus'"


def _merge(db: Db) -> DataFrame:
    return population.merge_halves(db.popall, MSL, *OVER)


def _locus(column: str, least: float, most: float):
    return _q(lambda db: selection.loc_between(db.locus_facts, column, least, most))


def _deep_in_many(db: Db) -> DataFrame:
    """Loci with genotypes of a depth of 30 or more in 45 to 1000 individuals."""
    deep = db.facts.filter("tot_dep >= 30").select("poploc", "ind")
    return selection.loc_between(selection.locus_facts(deep, db.links, db.facts, db.popall), "n_ind", 45, 1000)


def _deep(db: Db) -> DataFrame:
    """Genotypes of a total depth of 45 or more."""
    return db.facts.filter("tot_dep >= 45").select("poploc", "ind")


def _even(column: str) -> Column:
    return F.col(column) % 2 == 0


QUERIES = {
    "pool_alleles": (_q(lambda db: db.pool), f"{_POOL} SELECT seq, sl::BIGINT AS sl, n_founders FROM pool"),
    "pop_fragment_catalog": (_q(lambda db: db.pool.select("seq", F.posexplode(S.fragments(F.col("seq"), F.lit(D))).alias("k", "fragment")).groupBy("k", "fragment").agg(F.count(F.lit(1)).alias("n"))), f"{_POOL} SELECT k::BIGINT AS k, CASE WHEN k = 4 THEN substr(seq, 25) ELSE substr(seq, (k * 6 + 1)::INT, 6) END AS fragment, count(*) AS n FROM pool, range(0, 5) t(k) GROUP BY ALL"),
    "pop_pairs": (_q(lambda db: population.similar_pairs(db.pool, [], "seq", D, ignore_n=False)), f"{_PE} SELECT 32::BIGINT AS sl, x AS seq1, y AS seq2, hamming(x, y)::BIGINT AS dist FROM pe WHERE x < y"),
    "pop_loci": (_q(lambda db: population.pop_loci(db.pool, D)), f"{_POP} SELECT * FROM pa"),
    "poploc_stats": (_q(lambda db: population.poploc_stats(db.links)), f"{_LINK} SELECT poploc, count(DISTINCT ind) AS n_ind, count(DISTINCT (ind, loc)) AS n_indloc, (count(DISTINCT (ind, loc)) > count(DISTINCT ind))::BIGINT AS ties FROM lk GROUP BY poploc"),
    "poploc_consensus": (_q(lambda db: db.catalogue.select("poploc", "cons", "n_snp", "varpos")), f"{_CAT} SELECT poploc, cons, n_snp, varpos FROM ca"),
    "consensus_iupac": (_q(lambda db: db.popall.groupBy("poploc").agg(F.array_sort(F.collect_list("seq")).alias("s")).select("poploc", S.consensus_iupac(F.col("s")).alias("cons"))), f"{_CAT} SELECT poploc, cons FROM ca"),
    "var_chars": (_q(lambda db: db.popall.select("poploc", "popall", "popallvar")), f"{_VAR} SELECT poploc, popall, popallvar FROM pv"),
    "merge_halves": (_q(_merge), f"{_POP}, hv AS (SELECT poploc, popall, seq, q FROM pa, range(0, 9) t(q) WHERE q = 0 OR (q >= 2 AND substr(seq, (17 - q)::INT, q::INT) = substr(seq, 17, q::INT))), nn AS (SELECT poploc, count(*) AS n FROM pa GROUP BY poploc), hk AS (SELECT poploc, q, count(*) AS k FROM hv GROUP BY ALL), hm AS (SELECT hk.poploc, max(q) AS lon_over, max(q) FILTER (WHERE k = n) AS lon_com_over FROM hk JOIN nn ON hk.poploc = nn.poploc GROUP BY hk.poploc) SELECT pa.poploc, popall, substr(seq, 1, 16) || substr(seq, (17 + lon_com_over)::INT) AS merged, lon_over::BIGINT AS lon_over, lon_com_over::BIGINT AS lon_com_over, (lon_over != lon_com_over)::BIGINT AS merge_conflict, (32 - lon_com_over)::BIGINT AS new_sl FROM pa JOIN hm ON pa.poploc = hm.poploc"),
    "link_alleles": (_q(lambda db: db.links), f"{_LINK} SELECT ind, loc, all_id, poploc, popall, popallvar, depth FROM lk"),
    "link_loci": (_q(lambda db: db.loci_links), f"{_LINK} SELECT * FROM ll"),
    "split_loci": (_q(lambda db: population.split_loci(db.loci_links)), f"{_LINK} SELECT poploc, ind, loc FROM ll WHERE (ind, loc) IN (SELECT (ind, loc) FROM ll GROUP BY ind, loc HAVING count(*) > 1)"),
    "exclude_split": (_q(lambda db: selection.exclude_split(db.sel, population.split_loci(db.loci_links)).gt), f"{_LINK} SELECT poploc, ind FROM gt WHERE poploc NOT IN (SELECT poploc FROM ll WHERE (ind, loc) IN (SELECT (ind, loc) FROM ll GROUP BY ind, loc HAVING count(*) > 1))"),
    "read_pair_join": (_q(lambda db: _pair_reads(db).groupBy("loc1", "loc2").agg(F.count(F.lit(1)).alias("n"))), f"{_MR} SELECT loc1, loc2, count(*) AS n FROM mr GROUP BY ALL"),
    "pair_counts": (_q(lambda db: pairs.pair_counts(_pair_reads(db))), f"{_MR} SELECT * FROM pcn"),
    "self_match": (_q(lambda db: pairs.self_match(_pair_reads(db))), f"{_MR} SELECT * FROM sm"),
    "pair_groups": (_q(_groups), f"{_PG} SELECT first, poploc FROM pg"),
    "poison_groups": (_q(lambda db: _clean(db)[1]), f"{_PG} SELECT pg.poploc, coalesce(n_seqpairs, 0) AS n_seqpairs, coalesce(n_ind, 0) AS n_ind FROM pg LEFT JOIN sm ON pg.poploc = sm.poploc WHERE first IN (SELECT first FROM bad)"),
    "loc_groups": (_q(lambda db: pairs.loc_groups(_clean(db)[0])), f"{_PG} SELECT dense_rank() OVER (ORDER BY first)::BIGINT AS loc_group, count(*) OVER (PARTITION BY first) AS n_loc, poploc FROM pg WHERE first NOT IN (SELECT first FROM bad)"),
    "group_size_hist": (_q(lambda db: pairs.group_size_hist(_clean(db)[0])), f"{_PG} SELECT n_loc, count(*) AS n_groups FROM (SELECT first, count(*) AS n_loc FROM pg WHERE first NOT IN (SELECT first FROM bad) GROUP BY first) x GROUP BY n_loc"),
    "cluster_units": (_q(lambda db: depth.cluster_units(db.catalogue, db.catalogue.select("poploc", F.floor((F.col("poploc") - 1) / 3).cast("long").alias("cluster")))), f"{_POP} SELECT DISTINCT poploc, (poploc - 1) // 3 AS unit, max(sl) OVER (PARTITION BY (poploc - 1) // 3) AS unit_sl FROM pa"),
    "unit_depth": (_q(lambda db: depth.unit_depth(db.loci_links, db.f.ind_loci, depth.cluster_units(db.catalogue)).select("unit", "ind", "dep")), f"{_UD} SELECT unit, ind, dep FROM ud"),
    "scaled_depth": (_q(lambda db: db.scaled.select("unit", "ind", "scaldep")), f"{_SC} SELECT unit, ind, round(scaldep, 6) AS scaldep FROM sc"),
    "depth_percentile": (_q(lambda db: db.scaled.select("unit", "ind", "dep_perc")), f"{_SC} SELECT unit, ind, round(dep_perc, 6) AS dep_perc FROM sc"),
    "unit_min_med_max": (_q(lambda db: depth.min_med_max(db.scaled)), f"{_MMM} SELECT * FROM mm"),
    "da_by_ind": (_q(lambda db: db.scaled), f"{_SC} SELECT range_no, unit, ind, dep, round(scaldep, 6) AS scaldep, round(dep_perc, 6) AS dep_perc FROM sc"),
    "da_all_loc": (_q(lambda db: depth.all_loci(depth.min_med_max(db.scaled), depth.cluster_units(db.catalogue))), f"{_MMM} SELECT unit AS poploc, 32::BIGINT AS sl, * EXCLUDE (range_no, unit) FROM mm"),
    "select_individuals": (_q(lambda db: db.sel.restrict(ind=db.sel.ind.filter(F.col("ind") % 3 != 0)).gt), f"{_LINK} SELECT poploc, ind FROM gt WHERE ind % 3 != 0"),
    "loc_list": (_q(lambda db: db.sel.restrict(loc=db.sel.loc.filter(_even("poploc"))).gt), f"{_LINK} SELECT poploc, ind FROM gt WHERE poploc % 2 = 0"),
    "gt_list": (_q(lambda db: db.sel.restrict(gt=db.sel.gt.filter((F.col("poploc") + F.col("ind")) % 4 == 0)).gt), f"{_LINK} SELECT poploc, ind FROM gt WHERE (poploc + ind) % 4 = 0"),
    "drop_empty_inds": (_q(lambda db: db.sel.restrict(gt=db.sel.gt.filter((F.col("poploc") == 1) & (F.col("ind") % 5 == 0))).ind), f"{_LINK} SELECT DISTINCT ind FROM gt WHERE poploc = 1 AND ind % 5 = 0"),
    "drop_empty_loci": (_q(lambda db: db.sel.restrict(gt=db.sel.gt.filter((F.col("ind") == 1) & _even("poploc"))).loc), f"{_LINK} SELECT DISTINCT poploc FROM gt WHERE ind = 1 AND poploc % 2 = 0"),
    "genotype_facts": (_q(lambda db: db.facts), f"{_FACT} SELECT poploc, ind, all_dep, n_all, least_dep, n_indloc, tot_dep, minor_dep, round(frac_used, 6) AS frac_used FROM fx"),
    "loc_sl": (_locus("sl", 32, 40), f"{_LF} SELECT poploc FROM nl WHERE sl BETWEEN 32 AND 40"),
    "loc_nind": (_q(_deep_in_many), f"{_FACT} SELECT poploc FROM fx WHERE tot_dep >= 30 GROUP BY poploc HAVING count(*) BETWEEN 45 AND 1000"),
    "loc_nall": (_locus("n_all", 2, 2), f"{_LF} SELECT poploc FROM nl WHERE n_all = 2"),
    "loc_nsnp": (_locus("n_snp", 1, 2), f"{_LF} SELECT poploc FROM ca WHERE n_snp BETWEEN 1 AND 2"),
    "loc_nall_ind": (_locus("n_all_ind", 2, 2), f"{_LF} SELECT poploc FROM lf WHERE n_all_ind = 2"),
    "loc_ties": (_locus("ties", 0, 0), f"{_LF} SELECT poploc FROM lf WHERE ties = 0"),
    "loc_fracud": (_locus("least_frac", 0.85, 1.0), f"{_LF} SELECT poploc FROM lf WHERE least_frac BETWEEN 0.85::DOUBLE AND 1.0"),
    "loc_split": (_q(lambda db: db.sel.loc.join(population.split_loci(db.loci_links).select("poploc").distinct(), "poploc", "left_anti")), f"{_LINK} SELECT DISTINCT poploc FROM gt WHERE poploc NOT IN (SELECT poploc FROM ll WHERE (ind, loc) IN (SELECT (ind, loc) FROM ll GROUP BY ind, loc HAVING count(*) > 1))"),
    "loc_pairs": (_q(lambda db: selection.loc_pairs(db.f.mate_reads.select(F.col("loc").alias("poploc")).distinct(), pairs.loc_groups(_clean(db)[0]), _clean(db)[1])), f"{_PG} SELECT min(poploc) AS poploc FROM pg WHERE first NOT IN (SELECT first FROM bad) GROUP BY first HAVING count(*) = 2"),
    "loc_depth": (_q(lambda db: selection.loc_depth(db.sel.loc, depth.all_loci(depth.min_med_max(db.scaled), depth.cluster_units(db.catalogue)), [(1, 100, "med_scaldep", 0.5)])), f"{_MMM} SELECT unit AS poploc FROM mm WHERE coalesce(med_scaldep, 0) <= 0.5"),
    "loc_merge": (_q(lambda db: _merge(db).filter("merge_conflict = 0").select("poploc").distinct()), f"{_POP}, hv AS (SELECT poploc, popall, q FROM pa, range(0, 9) t(q) WHERE q = 0 OR (q >= 2 AND substr(seq, (17 - q)::INT, q::INT) = substr(seq, 17, q::INT))), nn AS (SELECT poploc, count(*) AS n FROM pa GROUP BY poploc), hk AS (SELECT poploc, q, count(*) AS k FROM hv GROUP BY ALL) SELECT hk.poploc FROM hk JOIN nn ON hk.poploc = nn.poploc GROUP BY hk.poploc HAVING max(q) = max(q) FILTER (WHERE k = n)"),
    "gt_depth": (_gt_where("all_dep", lambda c: c >= 20), f"{_FACT} SELECT poploc, ind FROM fx WHERE all_dep >= 20"),
    "gt_total_depth": (_gt_where("tot_dep", lambda c: c >= 25), f"{_FACT} SELECT poploc, ind FROM fx WHERE tot_dep >= 25"),
    "gt_fracud": (_gt_where("frac_used", lambda c: c >= 0.9), f"{_FACT} SELECT poploc, ind FROM fx WHERE frac_used >= 0.9::DOUBLE"),
    "gt_minor_depth": (_gt_where("minor_dep", lambda c: c >= 10), f"{_FACT} SELECT poploc, ind FROM fx WHERE minor_dep >= 10"),
    "gt_nall": (_gt_where("n_all", lambda c: c.between(2, 2)), f"{_FACT} SELECT poploc, ind FROM fx WHERE n_all = 2"),
    "selection_report": (_q(lambda db: selection.selection_report(db.sel, db.sel.restrict(ind=db.sel.ind.filter(F.col("ind") % 3 != 0)))), f"{_LINK} SELECT 'ind' AS what, count(DISTINCT ind) AS n_before, count(DISTINCT ind) FILTER (WHERE ind % 3 != 0) AS n_after FROM gt UNION ALL SELECT 'loc', count(DISTINCT poploc), count(DISTINCT poploc) FILTER (WHERE ind % 3 != 0) FROM gt UNION ALL SELECT 'gt', count(*), count(*) FILTER (WHERE ind % 3 != 0) FROM gt"),
    "genotype_matrix": (_q(_wide("alleles")), f"{_CELL} SELECT l.poploc, i.ind, coalesce(ce.alleles, '-999') AS alleles FROM (SELECT DISTINCT poploc FROM gt) l, (SELECT DISTINCT ind FROM gt) i LEFT JOIN ce ON ce.poploc = l.poploc AND ce.ind = i.ind"),
    "depth_matrix": (_q(_wide("depths")), f"{_CELL} SELECT l.poploc, i.ind, coalesce(ce.depths, '-999') AS depths FROM (SELECT DISTINCT poploc FROM gt) l, (SELECT DISTINCT ind FROM gt) i LEFT JOIN ce ON ce.poploc = l.poploc AND ce.ind = i.ind"),
    "locus_table": (_q(lambda db: export.locus_table(db.catalogue, db.sel.loc).withColumn("pos", F.array_join("pos", ","))), f"{_CAT}, po AS (SELECT poploc, coalesce(string_agg((p - 1)::VARCHAR, ',' ORDER BY p) FILTER (WHERE k > 1), '') AS pos FROM ca_c GROUP BY poploc), nn AS (SELECT poploc, any_value(sl)::BIGINT AS sl, count(*) AS n_all FROM pa GROUP BY poploc) SELECT ca.poploc, sl, cons, n_snp, varpos, n_all, pos FROM ca JOIN po ON po.poploc = ca.poploc JOIN nn ON nn.poploc = ca.poploc"),
    "locus_table_selected": (_q(lambda db: export.locus_table_selected(db.links, _deep(db), db.popall)), f"{_FACT}, dp AS (SELECT lk.* FROM lk JOIN fx ON fx.poploc = lk.poploc AND fx.ind = lk.ind WHERE tot_dep >= 45), ev AS (SELECT DISTINCT poploc, popall, seq FROM dp), {_cat('ev', 'cs')}, ne AS (SELECT poploc, count(DISTINCT ind) AS n_ind, count(DISTINCT (ind, loc)) AS n_indloc, count(DISTINCT popall) AS n_all, any_value(length(seq)) AS sl FROM dp GROUP BY poploc), mj AS (SELECT poploc, max(n)::BIGINT AS count_maj FROM (SELECT poploc, popall, sum(CASE WHEN k = 1 THEN 2 ELSE 1 END) AS n FROM (SELECT *, count(*) OVER (PARTITION BY poploc, ind) AS k FROM (SELECT DISTINCT poploc, ind, popall FROM dp) u) v GROUP BY ALL) w GROUP BY poploc) SELECT cs.poploc, sl, count_maj, cons, n_snp, varpos, n_all, n_ind, n_indloc, (n_indloc > n_ind)::BIGINT AS ties FROM cs JOIN ne ON cs.poploc = ne.poploc JOIN mj ON mj.poploc = cs.poploc"),
    "major_allele_count": (_q(lambda db: export.major_allele_count(db.links, db.sel.gt)), f"{_SEQ} SELECT poploc, max(n)::BIGINT AS count_maj FROM (SELECT poploc, popall, sum(n_copies) AS n FROM sc2 GROUP BY ALL) x GROUP BY poploc"),
    "gt_prune_alleles": (_q(lambda db: export.gt_prune_alleles(db.links, _deep(db))), f"{_FACT} SELECT DISTINCT lk.poploc, popall, popallvar FROM lk JOIN fx ON fx.poploc = lk.poploc AND fx.ind = lk.ind WHERE tot_dep >= 45"),
    "gt_allele_limit": (_q(lambda db: export.gt_allele_limit(db.seen)), f"{_LINK} SELECT max(n) AS n_most, (max(n) <= 99)::BIGINT AS fits FROM (SELECT poploc, count(*) AS n FROM pa GROUP BY poploc) x"),
    "gt_drop_invariant": (_q(lambda db: export.gt_drop_invariant(db.seen)), f"{_LINK} SELECT poploc FROM pa GROUP BY poploc HAVING count(*) > 1"),
    "gt_first_snp": (_q(lambda db: export.gt_first_snp(db.seen)), f"{_SN} SELECT poploc, popall, pos, base, (instr('ACGT', base))::BIGINT AS code FROM fs"),
    "gt_biallelic": (_q(lambda db: export.gt_biallelic(export.gt_first_snp(db.seen))), f"{_SN} SELECT * FROM bi"),
    "gt_trim_varpos": (_q(lambda db: export.gt_trim_varpos(export.gt_prune_alleles(db.links, _deep(db)))), f"{_FACT}, sn AS (SELECT DISTINCT lk.poploc, popall, popallvar FROM lk JOIN fx ON fx.poploc = lk.poploc AND fx.ind = lk.ind WHERE tot_dep >= 45), l3 AS (SELECT poploc, popall, p, substr(popallvar, (p + 1)::INT, 1) AS base FROM sn, range(0, 32) t(p) WHERE popallvar != 'consensus' AND p < length(popallvar)), v3 AS (SELECT poploc, p FROM l3 GROUP BY ALL HAVING count(DISTINCT base) > 1) SELECT sn.poploc, sn.popall, coalesce(string_agg(base, '' ORDER BY l3.p) FILTER (WHERE v3.p IS NOT NULL), '') AS trimmed FROM sn LEFT JOIN l3 ON sn.poploc = l3.poploc AND sn.popall = l3.popall LEFT JOIN v3 ON v3.poploc = l3.poploc AND v3.p = l3.p GROUP BY sn.poploc, sn.popall"),
    "gt_renumber": (_q(lambda db: export.gt_renumber(db.seen)), f"{_DIP} SELECT poploc, popall, allele_no FROM nm"),
    "gt_diploid": (_q(lambda db: export.gt_diploid(db.links, _two_at_most(db), export.gt_renumber(db.seen))), f"{_DIP} SELECT poploc, ind, a1, a2 FROM di WHERE k <= 2"),
    "locus_offsets": (_q(lambda db: export.locus_offsets(db.catalogue.select("poploc", F.col("n_snp").alias("len")))), f"{_CAT} SELECT poploc, (sum(n_snp) OVER (ORDER BY poploc) - n_snp + 1)::BIGINT AS start, (sum(n_snp) OVER (ORDER BY poploc))::BIGINT AS end FROM ca"),
    "alignment_dna": (_q(lambda db: _alignment(db, "dna")), f"{_LINK}, {_alignment_sql(_SHOWN, 'N')}"),
    "alignment_binary": (_q(lambda db: _alignment(db, "binary")), f"{_SN}, {_alignment_sql('SELECT poploc, popall, bin::VARCHAR AS part FROM bi', '-')}"),
    "alignment_build": (_q(lambda db: export.alignment_dosage(export.dosage(db.links, _two_at_most(db), export.gt_biallelic(export.gt_first_snp(db.seen))))), f"{_SN}, ok AS (SELECT poploc, ind FROM lk GROUP BY ALL HAVING count(DISTINCT popall) <= 2), ds AS (SELECT x.poploc, x.ind, CASE WHEN count(*) = 1 THEN 2 * max(bin) ELSE sum(bin) END AS dosage FROM (SELECT DISTINCT lk.poploc, lk.ind, lk.popall FROM lk JOIN ok ON lk.poploc = ok.poploc AND lk.ind = ok.ind) x JOIN bi ON x.poploc = bi.poploc AND x.popall = bi.popall GROUP BY ALL) SELECT i.ind, string_agg(coalesce(ds.dosage::INT::VARCHAR, '-'), '' ORDER BY l.poploc) AS seq FROM (SELECT DISTINCT poploc FROM ds) l CROSS JOIN (SELECT DISTINCT ind FROM ds) i LEFT JOIN ds ON ds.poploc = l.poploc AND ds.ind = i.ind GROUP BY i.ind"),
    "seq_indall": (_q(lambda db: export.seq_indall(db.links, db.sel.gt, db.popall, db.sel.ind.select("ind", F.concat(F.lit("g"), (F.col("ind") % 3).cast("string")).alias("grp")))), f"{_SEQ} SELECT poploc, popall, ind, 'g' || ind % 3 AS grp, n_copies, seq FROM sc2"),
    "seq_nonidentical": (_q(lambda db: export.seq_nonidentical(db.links, db.sel.gt, db.popall)), f"{_LINK} SELECT DISTINCT poploc, popall, seq FROM lk"),
    "seq_individual": (_q(lambda db: export.seq_individual(db.links, _two_at_most(db), db.popall)), f"{_SEQ}, s2 AS (SELECT poploc, ind, min(seq) AS a, max(seq) AS b FROM sq GROUP BY ALL HAVING count(*) <= 2) SELECT poploc, ind, 1::BIGINT AS copy, a AS seq FROM s2 UNION ALL SELECT poploc, ind, 2::BIGINT, b FROM s2"),
    "svars_drilldown": (_q(lambda db: export.svars_drilldown(db.links, db.f.reads.groupBy("ind", F.col("tl").alias("loc"), "seq").agg(F.count(F.lit(1)).alias("depth")).withColumn("svarcat", F.when(F.col("depth") > 1, "used").otherwise("discarded")), db.f.alleles)), f"{_LINK} SELECT poploc, ind, 'allele' AS kind, seq, depth::DOUBLE AS depth FROM lk UNION ALL SELECT l.poploc, l.ind, CASE WHEN s.depth > 1 THEN 'used' ELSE 'discarded' END, s.seq, s.depth::DOUBLE FROM ll l JOIN (SELECT ind, tl AS loc, seq, count(*) AS depth FROM v_reads GROUP BY ALL) s ON l.ind = s.ind AND l.loc = s.loc"),
}
