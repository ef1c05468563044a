"""Queries on scans, text formats, indel clusters and reads drawn from genotypes."""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.operators import depth, export, indel, population, reads_qc, simulate
from locuspark.plans.ordering import ranked
from locuspark.plans.scratch import materialize, scratch_dir
from locuspark.queries.catalog_tables import _DIP, _LINK, _MMM, _POP, _SEQ, Db, _long, _q, _two_at_most
from locuspark.queries.fixtures import Fixture
from locuspark.queries.reads import LIMITS
from locuspark.sources import fastq, tables, text_sinks

#: Seed of whatever is drawn.
SEED = 5


def _written(f: Fixture, lines: DataFrame) -> str:
    """A text file of one column, in the scratch folder."""
    path = f"{scratch_dir(f.spark)}/{uuid.uuid4().hex}.txt"
    lines.coalesce(1).write.text(path)
    return path


def _files(f: Fixture, lines: DataFrame) -> list[str]:
    """Text files of one column, one for each task, in the order of the tasks."""
    path = f"{scratch_dir(f.spark)}/{uuid.uuid4().hex}"
    lines.write.text(path)
    return sorted(f.spark.read.text(path).inputFiles())


#: Splits of about so many bytes at least, and about so many splits at most.
SPLIT_BYTES, SPLITS = 400_000, 200


def _split_bytes(f: Fixture, paths: list[str]) -> int:
    """Bytes of a split of these files: small ones for small files, but the number of splits (a task each) does not grow beyond ``SPLITS``."""
    total = f.spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0
    return max(SPLIT_BYTES, -(-total // SPLITS))


def _in_small_splits(f: Fixture, paths: list[str], read) -> DataFrame:
    """What is read, written anew, with the files cut into many splits, but not into more than are of use."""
    name = "spark.sql.files.maxPartitionBytes"
    before = f.spark.conf.get(name)
    f.spark.conf.set(name, str(_split_bytes(f, paths)))
    try:
        return materialize(read())
    finally:
        f.spark.conf.set(name, before)


def scan_fastq(f: Fixture) -> DataFrame:
    """Reads written as four lines each and scanned again, in many splits."""
    record = F.concat_ws("\n", F.concat(F.lit("@r_"), "o", F.lit("_"), "i", F.lit("_"), "tl"), "seq", F.lit("+"), "qual")
    paths = _files(f, f.reads_q.select(record.alias("line")))
    back = _in_small_splits(f, paths, lambda: fastq.read(f.spark, paths).select("header", "seq", "qual"))
    return back.groupBy("header", "seq", "qual").agg(F.count(F.lit(1)).alias("n"))


def _line(*columns: str) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("line")


def _lengths(f: Fixture, note: str) -> DataFrame:
    """Lines of the lengths of raw reads, with a tenth and a seventh of each; a line that is no row of the table among them."""
    sl = f.raw.select(F.length("seq").alias("sl")).distinct()
    rows = sl.select(F.concat_ws(" ", "sl", F.floor(F.col("sl") / 10), F.floor(F.col("sl") / 7)).alias("line"))
    return rows.unionByName(sl.select(F.concat(F.lit(note), F.col("sl").cast("string")).alias("line")))


def scan_dist_table_ind(f: Fixture) -> DataFrame:
    return _long(tables.dist_table(f.spark, _written(f, _lengths(f, "no numbers of "))))


def scan_dist_table_pop(f: Fixture) -> DataFrame:
    rows = _lengths(f, "x ").select(F.regexp_replace("line", r"^(\d+) (\d+) \d+$", "$1 $2").alias("line"))
    return _long(tables.dist_table(f.spark, _written(f, rows), ("sl", "dist"), (1, 6)))


def scan_filter_positions(f: Fixture) -> DataFrame:
    """The least score at each position of either mate, as limits of the positional filter."""
    score = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda p: F.ascii(F.substr(s, p, F.lit(1))) - 33)
    rows = [f.mates.select(F.lit(s).alias("strand"), F.posexplode(score(f"{s}_qual")).alias("p", "score")) for s in "fr"]
    least = rows[0].unionByName(rows[1]).groupBy("strand", (F.col("p") + 1).alias("pos")).agg(F.min("score").alias("score"))
    return _long(tables.filter_positions(f.spark, _written(f, least.select(_line("strand", "pos", "score")))))


def _list_file(f: Fixture, lines: list[str]) -> str:
    """A list of files of reads, as a user gives it."""
    return _written(f, f.spark.createDataFrame([(x,) for x in lines], "line string"))


def scan_file_list_single(f: Fixture) -> DataFrame:
    """Reads in the files of a list, one a line, counted by individual."""
    record = F.concat_ws("\n", F.concat_ws("_", F.lit("@r"), "ind", "o", "i", "tl"), "seq", F.lit("+"), "qual")
    listed = _list_file(f, _files(f, f.reads_q.select(record.alias("line"))))
    back = fastq.read(f.spark, tables.file_list(f.spark, listed))
    return back.groupBy(F.split("header", "_")[1].cast("long").alias("ind")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("qual").alias("most"))


def scan_file_list_paired(f: Fixture) -> DataFrame:
    """Mates in the pairs of files of a list, two a line, counted by individual."""
    rows = f.mates.withColumn("name", F.concat_ws("_", F.lit("@p"), "ind", "o", "i", "tl"))
    sides = [_files(f, rows.select(F.concat_ws("\n", "name", f"{s}_seq", F.lit("+"), f"{s}_qual").alias("line"))) for s in ("f", "r")]
    listed = _list_file(f, ["\t".join(p) for p in zip(*sides, strict=True)])
    back = fastq.read_pairs(f.spark, tables.file_pairs(f.spark, listed))
    return back.groupBy(F.split("f_header", "_")[1].cast("long").alias("ind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f_header") == F.col("r_header")).alias("n_mates"), F.min("f_seq").alias("first"), F.max("r_seq").alias("last"))


def _figures(f: Fixture) -> DataFrame:
    """What a user would set after a look at the reads: one row."""
    return f.reads.agg(F.count_distinct("ind").alias("inds"), F.count_distinct("tl").alias("loci"), F.max(F.length("seq")).alias("length"), F.max("read_no").alias("reads"))


def scan_settings_kv(f: Fixture) -> DataFrame:
    """Settings with comments, a key without a value and an empty line."""
    names = _figures(f).columns
    text = _figures(f).select(F.concat_ws("\n", *[F.concat_ws(" ", F.lit(c), F.col(c).cast("string"), F.lit("# of the reads")) for c in names], F.lit(""), F.lit("barcodes"))).first()[0]
    return f.spark.createDataFrame(sorted(tables.settings(text, {*names, "barcodes"}).items()), "key string, value string")


def settings_echo(f: Fixture) -> DataFrame:
    """The settings of a run, with its figures and its seed, for a replay."""
    found = _figures(f).first().asDict()
    return f.spark.createDataFrame(tables.settings_rows(simulate.Settings(**found, seed=SEED)), "key string, value string")


def _codes(f: Fixture) -> DataFrame:
    """The different barcodes before the site, but for the damaged ones."""
    code = F.substr(F.col("seq"), F.lit(1), F.length("seq") - 37)
    return f.raw.select(code.alias("barcode")).filter("barcode not like 'N%'").distinct()


def scan_barcodes(f: Fixture) -> DataFrame:
    got = tables.barcodes(f.spark, _written(f, _codes(f).select(F.col("barcode").alias("line"))))
    return f.spark.createDataFrame([(x,) for x in got], "barcode string")


def scan_bc_adapters(f: Fixture) -> DataFrame:
    """Adapters that begin with a code of two bases and go on with the barcode's end."""
    lines = _codes(f).select(F.concat("barcode", F.lit(" R"), F.substr(F.col("barcode"), F.lit(3))).alias("line"))
    got = tables.barcode_adapters(f.spark, _written(f, lines))
    return f.spark.createDataFrame([(b, a) for b, x in got.items() for a in x], "barcode string, adapter string")


def scan_sl_ranges(f: Fixture) -> DataFrame:
    """Ranges from each length of raw reads to the next."""
    lines = f.raw.select(F.length("seq").alias("lo")).distinct().select(F.concat_ws("\t", "lo", F.col("lo") + 1).alias("line"))
    return f.spark.createDataFrame(tables.sl_ranges(f.spark, _written(f, lines)), "lo long, hi long")


def scan_usearch_uc(f: Fixture) -> DataFrame:
    """Clusters written as records of a clustering tool and read again."""
    reps = _gapped(f).withColumnRenamed("id", "poploc")
    found = f.stage("gapped_clusters", lambda: indel.clusters(reps))
    return tables.cluster_records(f.spark, _files(f, indel.records(reps, found)))


def merge_settings(f: Fixture) -> DataFrame:
    """Overlaps of halves allowed for twice the length of raw reads, merged to that length and up to 19 more."""
    rows = f.raw.select((2 * F.length("seq")).alias("msl"), (F.length("seq") + F.col("ind") % 20).alias("spl")).distinct().collect()
    got = [(msl, spl, *(population.merge_settings(msl, spl, 30) or (0, 0))) for msl, spl in rows]
    return f.spark.createDataFrame(got, "msl long, spl long, mino long, maxo long")


def sim_reads(f: Fixture) -> DataFrame:
    """Reads drawn without error from the diploid genotypes: how many of each locus and individual, and from how many alleles."""
    db = Db(f)
    seqs = export.seq_individual(db.links, _two_at_most(db), db.popall)
    copies = seqs.join(db.popall.select("poploc", "popall", "seq"), ["poploc", "seq"])
    drawn = simulate.sim_reads(copies, simulate.Settings(reads=40, error=0.0, length=32, seed=SEED))
    key = F.split("header", "_")
    drawn = drawn.select("ind", key[1].cast("long").alias("poploc"), key[2].cast("long").alias("popall"), "seq")
    ok = drawn.join(db.popall.select("poploc", "popall", F.col("seq").alias("true")), ["poploc", "popall"])
    return _long(ok.groupBy("poploc", "ind").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(F.col("seq") == F.col("true")).alias("n_true"), F.count_distinct("popall").alias("n_alleles")))


def scan_ind_infiles(f: Fixture) -> DataFrame:
    rows = f.reads.select(F.concat(F.col("ind").cast("string"), F.lit("\treads_"), F.col("ind").cast("string"), F.lit(".fq")).alias("line")).distinct()
    return tables.ind_infiles(f.spark, _written(f, rows))


def scan_selection(f: Fixture) -> DataFrame:
    db = Db(f)
    keys = db.sel.loc.filter("poploc % 3 = 0").select(F.col("poploc").cast("string").alias("line"))
    return tables.selection(f.spark, db.loci_links, loc=_written(f, keys)).gt


def phred_histogram_wide(f: Fixture) -> DataFrame:
    hist = reads_qc.phred_histogram(f.reads_q.withColumn("file", F.lit("all")), ["file"])
    wide = reads_qc.phred_histogram_wide(hist, ["file"], list(range(12, 41)))
    return wide.select("file", F.col("pos").cast("long").alias("pos"), *[F.round(F.col(str(k)), 6).alias(str(k)) for k in range(12, 41)])


def _diploid(db: Db) -> DataFrame:
    return export.gt_diploid(db.links, _two_at_most(db), export.gt_renumber(db.seen))


def _pops(db: Db) -> DataFrame:
    return db.sel.ind.select("ind", (F.col("ind") % 3).alias("pop"))


def _labelled(db: Db) -> DataFrame:
    return export.seq_nonidentical(db.links, db.sel.gt, db.popall)


def _name() -> Column:
    return F.concat_ws("_", F.col("poploc").cast("string"), F.col("popall").cast("string"))


def _gapped(f: Fixture) -> DataFrame:
    """(id, seq): the different sequences of the reads, without N, every seventh with letters put in."""
    return f.stage("gapped", lambda: ranked(f.reads.select(F.expr(_GAPPED).alias("seq")).distinct(), ["seq"], "id"))


def indel_greedy(f: Fixture) -> DataFrame:
    """Sequences of lengths from 29 to 35 in clusters around centroids."""
    rows = _gapped(f)
    found = f.stage("gapped_clusters", lambda: indel.clusters(rows.withColumnRenamed("id", "poploc")))
    return rows.join(found.withColumnRenamed("poploc", "id"), "id")


def _only(df: DataFrame) -> DataFrame:
    return df.select("line")


def scan_fastq_pair(f: Fixture) -> DataFrame:
    """Mates written to two sets of files and matched by their place."""
    rows = f.mates.withColumn("name", F.concat_ws("_", F.lit("@p"), "o", "i", "tl"))
    paths = [_files(f, rows.select(F.concat_ws("\n", "name", f"{s}_seq", F.lit("+"), f"{s}_qual").alias("line"))) for s in ("f", "r")]
    back = _in_small_splits(f, [p for side in paths for p in side], lambda: fastq.read_pairs(f.spark, list(zip(*paths, strict=True))).select("f_header", "r_header", "f_seq", "r_seq"))
    return back.groupBy("f_header", "r_header", "f_seq", "r_seq").agg(F.count(F.lit(1)).alias("n"))


def phred_filter_written(f: Fixture) -> DataFrame:
    """Reads that pass the positional filter, written by file and scanned again, beside the report."""
    path = f"{scratch_dir(f.spark)}/{uuid.uuid4().hex}"
    reads = f.reads_q.select((F.col("ind") % 5).cast("int").alias("file"), F.concat_ws("_", F.lit("@r"), "ind", "o", "i", "tl").alias("header"), "seq", "qual")
    report = reads_qc.write_filtered(reads, LIMITS, path, "file", compress=True)
    back = fastq.read_folder(f.spark, path, ["file"]).groupBy(F.col("file").alias("of")).agg(F.count(F.lit(1)).alias("n_written"), F.min("header").alias("first"), F.max("header").alias("last"), F.max("qual").alias("most"))
    # A file of which no read passes is not written, but is in the report.
    both = report.select("file", "n_seq", "n_bad", "n_good").join(back, F.col("file").eqNullSafe(F.col("of")), "left").drop("of")
    return _long(both.withColumn("n_written", F.coalesce("n_written", F.lit(0).cast("long"))))


def phred_filter_pair_written(f: Fixture) -> DataFrame:
    """Pairs of which both mates pass, written as two sets of files and matched by their place."""
    path = f"{scratch_dir(f.spark)}/{uuid.uuid4().hex}"
    header = lambda n: F.concat_ws("_", F.lit("@p"), "ind", "o", "i", "tl", F.lit(n)).alias
    pairs = f.mates.select((F.col("ind") % 3).cast("int").alias("file"), header("1")("f_header"), "f_seq", "f_qual", header("2")("r_header"), "r_seq", "r_qual")
    reads_qc.write_filtered_pairs(pairs, [(1, 20), (3, 18)], [(2, 16)], path, "file")
    sides = [sorted(f.spark.read.text(f"{path}/{s}").inputFiles()) for s in "fr"]
    both = fastq.read_pairs(f.spark, list(zip(*sides, strict=True)))
    return both.select("f_header", "r_header", "f_seq", "r_seq").groupBy("f_header", "r_header", "f_seq", "r_seq").agg(F.count(F.lit(1)).alias("n"))


def sink_structure_columns(f: Fixture) -> DataFrame:
    """STRUCTURE lines with columns of a user's table after the names."""
    db = Db(f)
    lines = db.sel.ind.select(F.concat_ws("\t", F.col("ind").cast("string"), (F.col("ind") % 3).cast("string"), F.concat(F.lit("site"), (F.col("ind") % 4).cast("string"))).alias("line"))
    user = tables.user_groups(f.spark, _written(f, lines), db.sel.ind, more=["pop", "site"])
    return _only(text_sinks.structure(_diploid(db), user.select("ind", F.concat_ws("\t", "pop", "site").alias("columns"))))


def svars_fasta(f: Fixture) -> DataFrame:
    """Alleles and svars of each locus and individual as FASTA files by locus, scanned again."""
    db = Db(f)
    svars = f.reads.groupBy("ind", F.col("tl").alias("loc"), "seq").agg(F.count(F.lit(1)).alias("depth")).withColumn("svarcat", F.when(F.col("depth") > 1, "used").otherwise("discarded"))
    rows = export.svars_drilldown(db.links, svars, f.alleles)
    path = f"{scratch_dir(f.spark)}/{uuid.uuid4().hex}"
    label = F.concat_ws("_", "ind", "kind", F.col("depth").cast("long").cast("string"))
    text_sinks.write_fasta(rows, label, path, ["poploc"], [F.col(c) for c in ("ind", "kind", "seq", "depth")])
    back = f.spark.read.text(path)
    return back.filter("value like '>%'").groupBy("poploc", F.col("value").alias("header")).agg(F.count(F.lit(1)).alias("n")).unionByName(back.filter("value not like '>%'").groupBy("poploc", F.lit("").alias("header")).agg(F.count(F.lit(1)).alias("n"))).withColumn("poploc", F.col("poploc").cast("long"))


def _greedy(source: str) -> str:
    """Greedy centroids of (id, seq), one sequence after another."""
    return (
        f"gs AS MATERIALIZED ({source}), gn AS MATERIALIZED (SELECT x.id AS a, y.id AS b, length(x.seq) AS la, levenshtein(x.seq, y.seq) AS d FROM gs x JOIN gs y ON (length(x.seq) > length(y.seq) OR (length(x.seq) = length(y.seq) AND x.id < y.id)) AND 10 * length(y.seq) >= 9 * length(x.seq) WHERE 10 * levenshtein(x.seq, y.seq) <= length(x.seq)), "
        "go AS MATERIALIZED (SELECT row_number() OVER (ORDER BY length(seq) DESC, id) AS k, id, coalesce(nb, []) AS nb FROM gs LEFT JOIN (SELECT b, list(a) AS nb FROM gn GROUP BY b) n ON n.b = gs.id), "
        "gc AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS c UNION ALL SELECT o.k, CASE WHEN list_has_any(gc.c, o.nb) THEN gc.c ELSE list_append(gc.c, o.id) END FROM gc JOIN go o ON o.k = gc.k + 1), "
        "gx AS (SELECT unnest(c) AS id FROM gc WHERE k = (SELECT max(k) FROM gc)), gm AS (SELECT b, arg_min(a, (d, -la, a)) AS a FROM gn JOIN gx ON gx.id = gn.a WHERE b NOT IN (SELECT id FROM gx) GROUP BY b), "
        "gk AS (SELECT id, coalesce(a, id) AS cluster FROM gs LEFT JOIN gm ON gm.b = gs.id)"
    )


_REP = f"{_POP}, rp AS (SELECT poploc, seq FROM (SELECT *, row_number() OVER (PARTITION BY poploc ORDER BY popall) AS k FROM pa) x WHERE k = 1)"
_IND = f"{_REP}, {_greedy('SELECT poploc AS id, seq FROM rp')}, ic AS (SELECT id AS poploc, cluster FROM gk)"
_GAPPED = "CASE o % 7 WHEN 0 THEN concat(substr(replace(seq, 'N', ''), 1, CAST(1 + tl AS INT)), substr('ACGT', CAST(1 + i % 4 AS INT), 1 + CAST(i % 3 AS INT)), substr(replace(seq, 'N', ''), CAST(2 + tl AS INT))) ELSE replace(seq, 'N', '') END"
_GREEDY = f"{_greedy(f'SELECT dense_rank() OVER (ORDER BY seq)::BIGINT AS id, seq FROM (SELECT DISTINCT {_GAPPED} AS seq FROM v_reads) d')}"
_GRID = f"{_DIP}, ok2 AS (SELECT * FROM di WHERE k <= 2), gd AS (SELECT l.poploc, i.ind, a1, a2 FROM (SELECT DISTINCT poploc FROM ok2) l CROSS JOIN (SELECT DISTINCT ind FROM ok2) i LEFT JOIN ok2 ON ok2.poploc = l.poploc AND ok2.ind = i.ind)"

_ARLEQUIN = """SELECT unnest(['[Profile]', 'Title="Title"', 'NbSamples=' || (SELECT count(*) FROM pops), 'DataType=STANDARD', 'GenotypicData=1', 'GameticPhase=0', 'LocusSeparator=WHITESPACE', 'MissingData="?"', '[Data]', '[[Samples]]', '[[Structure]]', 'StructureName="one group"', 'NbGroups=1', 'Group={', '}']) AS line
UNION ALL SELECT '"' || pop || '"' FROM pops
UNION ALL SELECT 'SampleName="' || ind % 3 || '"' || chr(10) || 'SampleSize=' || count(DISTINCT ind) || chr(10) || 'SampleData={' FROM gd GROUP BY ind % 3
UNION ALL SELECT '}' FROM pops
UNION ALL SELECT ind || ' 1 ' || string_agg(coalesce(a1::VARCHAR, '?'), ' ' ORDER BY poploc) FROM gd GROUP BY ind
UNION ALL SELECT '    ' || string_agg(coalesce(a2::VARCHAR, '?'), ' ' ORDER BY poploc) FROM gd GROUP BY ind"""

_GOOD_READ = " AND ".join(f"ascii(substr(qual, {p}, 1)) >= {33 + least}" for p, least in LIMITS)

_FIGURES = "SELECT unnest(['inds', 'loci', 'length', 'reads']) AS key, unnest([count(DISTINCT ind), count(DISTINCT tl), max(length(seq)), max(read_no)])::VARCHAR AS value FROM v_reads"
_CODES = "bc AS (SELECT DISTINCT substr(seq, 1, length(seq) - 37) AS barcode FROM v_raw WHERE seq NOT LIKE 'N%')"
#: Settings that are left as they are.
_OWN = [f for f in fields(simulate.Settings) if f.name not in ("inds", "loci", "length", "reads", "seed")]

QUERIES = {
    "phred_filter_written": (phred_filter_written, f"SELECT ind % 5 AS file, count(*) AS n_seq, count(*) FILTER (NOT ({_GOOD_READ})) AS n_bad, count(*) FILTER ({_GOOD_READ}) AS n_good, count(*) FILTER ({_GOOD_READ}) AS n_written, min(h) FILTER ({_GOOD_READ}) AS first, max(h) FILTER ({_GOOD_READ}) AS last, max(qual) FILTER ({_GOOD_READ}) AS most FROM (SELECT *, concat_ws('_', '@r', ind, o, i, tl) AS h FROM v_reads) r GROUP BY ind % 5"),
    "phred_filter_pair_written": (phred_filter_pair_written, "SELECT concat_ws('_', '@p', ind, o, i, tl, 1) AS f_header, concat_ws('_', '@p', ind, o, i, tl, 2) AS r_header, f_seq, r_seq, count(*) AS n FROM v_mates WHERE ascii(substr(f_qual, 1, 1)) >= 53 AND ascii(substr(f_qual, 3, 1)) >= 51 AND ascii(substr(r_qual, 2, 1)) >= 49 GROUP BY ALL"),
    "sink_structure_columns": (sink_structure_columns, f"{_GRID} SELECT ind || chr(9) || ind % 3 || chr(9) || 'site' || ind % 4 || chr(9) || string_agg(coalesce(a1::VARCHAR, '-9'), chr(9) ORDER BY poploc) AS line FROM gd GROUP BY ind UNION ALL SELECT ind || chr(9) || ind % 3 || chr(9) || 'site' || ind % 4 || chr(9) || string_agg(coalesce(a2::VARCHAR, '-9'), chr(9) ORDER BY poploc) FROM gd GROUP BY ind"),
    "svars_fasta": (svars_fasta, f"{_LINK}, dd AS (SELECT poploc, ind, 'allele' AS kind, depth::BIGINT AS depth FROM lk UNION ALL SELECT l.poploc, l.ind, CASE WHEN s.depth > 1 THEN 'used' ELSE 'discarded' END, s.depth FROM ll l JOIN (SELECT ind, tl AS loc, seq, count(*) AS depth FROM v_reads GROUP BY ALL) s ON l.ind = s.ind AND l.loc = s.loc) SELECT poploc, '>' || ind || '_' || kind || '_' || depth AS header, count(*) AS n FROM dd GROUP BY ALL UNION ALL SELECT poploc, '', count(*) FROM dd GROUP BY poploc"),
    "scan_dist_table_ind": (scan_dist_table_ind, "SELECT DISTINCT length(seq) AS sl, length(seq) // 10 AS hapdist, length(seq) // 7 AS rarehapdist FROM v_raw"),
    "scan_dist_table_pop": (scan_dist_table_pop, "SELECT DISTINCT length(seq) AS sl, length(seq) // 10 AS dist FROM v_raw"),
    "scan_filter_positions": (scan_filter_positions, "SELECT s AS strand, p::BIGINT AS pos, min(ascii(substr(CASE s WHEN 'f' THEN f_qual ELSE r_qual END, p::INT, 1)) - 33)::BIGINT AS min_score FROM v_mates, (VALUES ('f'), ('r')) x(s), range(1, 17) t(p) GROUP BY ALL"),
    "scan_file_list_single": (scan_file_list_single, "SELECT ind, count(*) AS n, min(seq) AS first, max(qual) AS most FROM v_reads GROUP BY ind"),
    "scan_file_list_paired": (scan_file_list_paired, "SELECT ind, count(*) AS n, count(*) AS n_mates, min(f_seq) AS first, max(r_seq) AS last FROM v_mates GROUP BY ind"),
    "scan_settings_kv": (scan_settings_kv, f"{_FIGURES} UNION ALL SELECT 'barcodes', ''"),
    "settings_echo": (settings_echo, f"{_FIGURES} UNION ALL SELECT unnest({[f.name for f in _OWN]}), unnest({[str(f.default) for f in _OWN]}) UNION ALL SELECT 'seed', '{SEED}'"),
    "scan_barcodes": (scan_barcodes, f"{_CODES} SELECT barcode FROM bc"),
    "scan_bc_adapters": (scan_bc_adapters, f"{_CODES} SELECT barcode, b || substr(barcode, 3) AS adapter FROM bc, (VALUES ('A'), ('G')) t(b)"),
    "scan_sl_ranges": (scan_sl_ranges, "SELECT DISTINCT length(seq) AS lo, length(seq) + 1 AS hi FROM v_raw"),
    "scan_usearch_uc": (scan_usearch_uc, f"{_GREEDY}, gr AS (SELECT id, length(seq) AS sl, cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS no FROM gk JOIN gs USING (id)) SELECT no AS cluster, 'L' || id AS label, 'H' AS kind, sl AS size FROM gr WHERE id <> cluster UNION ALL SELECT no, 'L' || cluster, 'C', count(*) FROM gr GROUP BY no, cluster"),
    "merge_settings": (merge_settings, "SELECT DISTINCT 2 * l AS msl, l + d AS spl, CASE WHEN l - d >= 30 THEN 30 ELSE 0 END::BIGINT AS mino, CASE WHEN l - d >= 30 THEN l - d ELSE 0 END AS maxo FROM (SELECT length(seq) AS l, ind % 20 AS d FROM v_raw) x"),
    "sim_reads": (sim_reads, f"{_DIP} SELECT poploc, ind, 40::BIGINT AS n_reads, 40::BIGINT AS n_true, k AS n_alleles FROM di WHERE k <= 2"),
    "scan_fastq": (scan_fastq, "SELECT concat('@r_', o, '_', i, '_', tl) AS header, seq, qual, count(*) AS n FROM v_reads GROUP BY ALL"),
    "scan_fastq_pair": (scan_fastq_pair, "SELECT concat('@p_', o, '_', i, '_', tl) AS f_header, concat('@p_', o, '_', i, '_', tl) AS r_header, f_seq, r_seq, count(*) AS n FROM v_mates GROUP BY ALL"),
    "scan_user_groups": (lambda f: tables.user_groups(f.spark, _written(f, f.ind_loci.select(F.concat(F.col("ind").cast("string"), F.lit("\tg"), (F.col("ind") % 3).cast("string")).alias("line")).distinct()), f.ind_loci.select("ind").distinct()), "SELECT DISTINCT ind, concat('g', ind % 3) AS grp FROM v_alleles"),
    "da_allind": (_q(lambda db: depth.min_med_max(db.scaled)), f"{_MMM} SELECT * FROM mm"),
    "scan_ind_infiles": (scan_ind_infiles, "SELECT DISTINCT ind::VARCHAR AS ind, concat('reads_', ind, '.fq') AS file FROM v_reads"),
    "scan_selection": (scan_selection, f"{_LINK} SELECT poploc, ind FROM gt WHERE poploc % 3 = 0"),
    "phred_histogram_wide": (phred_histogram_wide, "SELECT 'all' AS file, p::BIGINT AS pos, " + ", ".join(f"round(100.0::DOUBLE * (count(*) FILTER (WHERE ascii(substr(qual, p::INT, 1)) = {k + 33})) / count(*), 6) AS \"{k}\"" for k in range(12, 41)) + " FROM v_reads, range(1, 33) t(p) GROUP BY p"),
    "indel_representatives": (_q(lambda db: indel.representatives(db.popall, db.sel.loc)), f"{_REP} SELECT poploc, seq FROM rp"),
    "indel_cluster": (_q(lambda db: indel.clusters(indel.representatives(db.popall, db.sel.loc))), f"{_IND} SELECT poploc, cluster FROM ic"),
    "indel_outputs": (_q(lambda db: indel.outputs(indel.clusters(indel.representatives(db.popall, db.sel.loc)))[0]), f"{_IND} SELECT dense_rank() OVER (ORDER BY cluster)::BIGINT AS cluster_no, poploc, count(*) OVER (PARTITION BY cluster) AS n_loc FROM ic"),
    "indel_greedy": (indel_greedy, f"{_GREEDY} SELECT id, seq, cluster FROM gk JOIN gs USING (id)"),
    "sink_structure": (_q(lambda db: _only(text_sinks.structure(_diploid(db)))), f"{_GRID} SELECT ind::VARCHAR || chr(9) || string_agg(coalesce(a1::VARCHAR, '-9'), chr(9) ORDER BY poploc) AS line FROM gd GROUP BY ind UNION ALL SELECT ind::VARCHAR || chr(9) || string_agg(coalesce(a2::VARCHAR, '-9'), chr(9) ORDER BY poploc) FROM gd GROUP BY ind"),
    "sink_genepop": (_q(lambda db: _only(text_sinks.genepop(_diploid(db), _pops(db)))), f"{_GRID} SELECT 'Title' AS line UNION ALL SELECT DISTINCT poploc::VARCHAR FROM gd UNION ALL SELECT 'Pop' FROM (SELECT DISTINCT ind % 3 FROM gd) x UNION ALL SELECT ind::VARCHAR || ' , ' || string_agg(coalesce(lpad(a1::VARCHAR, 2, '0') || lpad(a2::VARCHAR, 2, '0'), '0000'), ' ' ORDER BY poploc) FROM gd GROUP BY ind"),
    "sink_arlequin": (_q(lambda db: _only(text_sinks.arlequin(_diploid(db), _pops(db)))), f"{_GRID}, pops AS (SELECT DISTINCT ind % 3 AS pop FROM gt) {_ARLEQUIN}"),
    "sink_fasta": (_q(lambda db: _only(text_sinks.fasta(_labelled(db), _name()))), f"{_LINK} SELECT DISTINCT '>' || poploc || '_' || popall || chr(10) || seq AS line FROM lk"),
    "sink_nexus": (_q(lambda db: _only(text_sinks.nexus(_labelled(db), _name()))), f"{_LINK}, u AS (SELECT DISTINCT poploc || '_' || popall AS name, seq FROM lk) SELECT name || ' ' || seq AS line FROM u UNION ALL SELECT unnest(['#NEXUS', 'BEGIN DATA;', 'DIMENSIONS NTAX=' || (SELECT count(*) FROM u) || ' NCHAR=32;', 'FORMAT DATATYPE=DNA MISSING=- GAP=N;', 'MATRIX', ';', 'END;'])"),
    "sink_phylip": (_q(lambda db: _only(text_sinks.phylip(_labelled(db), _name()))), f"{_LINK}, u AS (SELECT DISTINCT poploc || '_' || popall AS name, seq FROM lk) SELECT rpad(name, 13, ' ') || seq AS line FROM u UNION ALL SELECT (SELECT count(*) FROM u) || ' 32'"),
    "seq_individual_missing": (_q(lambda db: export.seq_individual(db.links, _two_at_most(db), db.popall, with_missing=True)), f"{_SEQ}, s2 AS (SELECT poploc, ind, min(seq) AS a, max(seq) AS b FROM sq GROUP BY ALL HAVING count(*) <= 2) SELECT l.poploc, i.ind, c.c::BIGINT AS copy, coalesce(CASE WHEN c.c = 1 THEN a ELSE b END, repeat('N', 32)) AS seq FROM (SELECT DISTINCT poploc FROM s2) l CROSS JOIN (SELECT DISTINCT ind FROM s2) i CROSS JOIN (VALUES (1), (2)) c(c) LEFT JOIN s2 ON s2.poploc = l.poploc AND s2.ind = i.ind"),
}
