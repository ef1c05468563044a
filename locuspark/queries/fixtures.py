"""Sequencing reads derived from ``lineitem`` by integer arithmetic.

The same text is SQL for Spark and for DuckDB but for the few functions named
in ``ENGINES``.  An individual is a supplier, a true locus a part modulo 20.
Spark spells out a read from whole strings (``_spelled``), which takes a few
operations a read in place of some a letter; the letters are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from locuspark.plans.scratch import materialize

ENGINES = {
    "spark": {"each": "array_join(transform(sequence(0L, {n}L), p -> {x}), '')", "chr": "chr"},
    "duckdb": {"each": "array_to_string(list_transform(range(0, {n} + 1), lambda p: {x}), '')", "chr": "chr"},
}

_BASE = "((7919*tl + 104729*p + 31*tl*p + (tl+13)*(p+7)*(p+7)) % 10007) % 4"
_LETTER = f"CASE WHEN p = (o + i) % 32 AND (11*o + 5*i) % 97 = 0 THEN 'N' ELSE substr('ACGT', CAST(1 + ({_BASE} + CASE WHEN p = (5*tl) % 32 AND tl % 6 <> 1 THEN a ELSE 0 END + CASE WHEN p = (7*o + 3*i) % 32 AND (13*o + i) % 41 = 0 THEN 2 ELSE 0 END) % 4 AS INT), 1) END"
_SCORE = "chr(CAST(73 - (3*o + 17*i + p*p) % 29 AS INT))"
BARCODES = ["ACGT", "TGCAT", "GATTAC", "CCTGA", "AGGTCA", "TTCCG", "CAAGT", "GTGTGA", "ATATCG", "CGCGAT", "TACTGG", "GGACTT"]
SITE = "GATCC"


def _spelled(seq: str, qual: str) -> tuple[str, str]:
    """``seq`` and ``qual`` of rows (tl, a, o, i), letter by letter only where keys are negative or null.

    A read is one of 40 sequences of a locus and its allele, with at most one wrong
    letter and one N; its scores are one of 29 strings.
    """
    letter = lambda tl, a, p: "ACGT"[((7919 * tl + 104729 * p + 31 * tl * p + (tl + 13) * (p + 7) ** 2) % 10007 % 4 + (a if p == 5 * tl % 32 and tl % 6 != 1 else 0)) % 4]
    true = ", ".join(f"'{''.join(letter(tl, a, p) for p in range(32))}'" for tl in range(20) for a in range(2))
    scores = ", ".join(f"'{''.join(chr(73 - (k + p * p) % 29) for p in range(32))}'" for k in range(29))
    wrong, none = "CAST((7*o + 3*i) % 32 + 1 AS INT)", "CAST((o + i) % 32 + 1 AS INT)"
    own = f"element_at(array({true}), CAST(2*tl + a + 1 AS INT))"
    own = f"CASE WHEN (13*o + i) % 41 = 0 THEN overlay({own} PLACING translate(substr({own}, {wrong}, 1), 'ACGT', 'GTAC') FROM {wrong}) ELSE {own} END"
    own = f"CASE WHEN (11*o + 5*i) % 97 = 0 THEN overlay({own} PLACING 'N' FROM {none}) ELSE {own} END"
    return f"CASE WHEN tl BETWEEN 0 AND 19 AND a BETWEEN 0 AND 1 AND o >= 0 AND i >= 0 THEN {own} ELSE {seq} END", f"CASE WHEN o >= 0 AND i >= 0 THEN element_at(array({scores}), CAST((3*o + 17*i) % 29 + 1 AS INT)) ELSE {qual} END"


def reads_sql(engine: str) -> str:
    """(ind, read_no, tl, o, i, seq, qual) of every row of lineitem."""
    each = ENGINES[engine]["each"]
    seq, qual = each.format(n=31, x=_LETTER), each.format(n=31, x=_SCORE)
    if engine == "spark":
        seq, qual = _spelled(seq, qual)
    rows = "SELECT CAST(l_suppkey AS BIGINT) AS ind, CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS i, CAST(l_partkey AS BIGINT) % 20 AS tl, CASE (CAST(l_suppkey AS BIGINT) + CAST(l_partkey AS BIGINT) % 20) % 3 WHEN 0 THEN (CAST(l_orderkey AS BIGINT) + CAST(l_linenumber AS BIGINT)) % 2 WHEN 1 THEN 1 ELSE 0 END AS a FROM lineitem"
    return f"SELECT ind, 8*o + i AS read_no, tl, o, i, {seq} AS seq, {qual} AS qual FROM ({rows}) r"


def raw_sql(engine: str) -> str:
    """Reads with a barcode (one letter damaged now and then) and a site before them."""
    del engine
    codes = " ".join(f"WHEN {k} THEN '{b}'" for k, b in enumerate(BARCODES))
    bc = f"CASE ind % 12 {codes} END"
    hurt = "CASE WHEN o % 29 = 0 THEN concat('N', substr(bc, 2)) ELSE bc END"
    site = f"CASE WHEN o % 31 = 0 THEN 'GTTCC' WHEN o % 37 = 0 THEN 'GCTCC' ELSE '{SITE}' END"
    return f"SELECT ind, o, i, tl, concat({hurt}, {site}, seq) AS seq, concat(substr(qual, 1, length(bc)), substr(qual, 1, 5), qual) AS qual FROM (SELECT *, {bc} AS bc FROM v_reads) x"


def pairs_sql(engine: str) -> str:
    """Mates: the first half of a read, and the reverse complement of the second."""
    del engine
    return "SELECT ind, o, i, tl, substr(seq, 1, 16) AS f_seq, substr(qual, 1, 16) AS f_qual, translate(reverse(substr(seq, 17)), 'ACGT', 'TGCA') AS r_seq, reverse(substr(qual, 17)) AS r_qual FROM v_reads"


#: Locus of a read in an individual.  Some individuals hold two true loci as one, which the catalogue
#: splits; others hold the two alleles of a true locus as two loci, which tie in the catalogue.
OWN_LOC = "CASE WHEN ind % 7 = 0 AND tl = 3 THEN 2 WHEN ind % 5 = 0 AND tl = 4 AND substr(seq, 21, 1) IN ('A', 'G') THEN 104 ELSE tl END"
#: Alleles of the fixture: sequences without N with a fifth of their locus's reads.
ALLELES = f"""SELECT ind, loc, CAST(row_number() OVER (PARTITION BY ind, loc ORDER BY seq) AS BIGINT) AS all_id, seq, depth, loc_dep FROM (
  SELECT ind, loc, seq, count(*) AS depth, CAST(sum(count(*)) OVER (PARTITION BY ind, loc) AS BIGINT) AS loc_dep FROM (SELECT ind, {OWN_LOC} AS loc, seq FROM v_reads) r GROUP BY ind, loc, seq) s
  WHERE seq NOT LIKE '%N%' AND 5 * depth >= loc_dep"""
#: Sequences of reads assigned to mates of loci: two loci of a pair are neighbours in number.
_KEYED = "(SELECT ind, o, i, tl, concat('L_', o, '_', i, '_', tl, '_{mate}_', row_number() OVER (PARTITION BY ind, o, i, tl ORDER BY seq)) AS read_key FROM v_reads) r"
MATES = f"SELECT ind, read_key, tl AS loc FROM {_KEYED.format(mate=1)} UNION ALL SELECT ind, read_key, CASE WHEN o % 97 = 0 AND tl >= 16 THEN tl WHEN tl % 2 = 0 THEN tl + 1 ELSE tl - 1 END AS loc FROM {_KEYED.format(mate=2)} WHERE tl < 18"


#: Stages of a set of tables that were written, by application, version of the tables and name.
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def forget_stages(*kept: str) -> None:
    """Let later queries work all stages out anew, but for the kept ones."""
    for key in [k for k in _WRITTEN if k[2] not in kept]:
        del _WRITTEN[key]


class Fixture:
    """The views of one set of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
        self.raw = self._sql(raw_sql("spark"), v_reads=self.reads_q)
        self.mates = self._sql(pairs_sql("spark"), v_reads=self.reads_q)
        self.mate_reads = self._sql(MATES, v_reads=self.reads)

    def _sql(self, text: str, **views: DataFrame) -> DataFrame:
        for name, df in views.items():
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
        return self.spark.sql(text, **views)

    @cached_property
    def version(self) -> str:
        """The files of the source, with their sizes and times."""
        found = self.line.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
        return str(sorted(map(tuple, found)))

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A stage of the genotype database: written when first asked for, then read."""
        key = (self.spark.sparkContext.applicationId, self.version, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = materialize(make())
        return _WRITTEN[key]

    @cached_property
    def reads_q(self) -> DataFrame:
        """The reads; spelling them out takes longer than most of what is done with them."""
        return self.stage("reads", lambda: self._sql(reads_sql("spark"), lineitem=self.line))

    @property
    def reads(self) -> DataFrame:
        return self.reads_q.drop("qual")

    @cached_property
    def alleles(self) -> DataFrame:
        """The alleles; they are few, but every query on genotypes would count the reads anew for each use of them."""
        return self.stage("alleles", lambda: self._sql(ALLELES, v_reads=self.reads))

    @property
    def ind_loci(self) -> DataFrame:
        return self.alleles.select("ind", "loc", "loc_dep").distinct()


def duckdb_views() -> str:
    """The same views as common table expressions."""
    return f"v_reads AS ({reads_sql('duckdb')}),\nv_raw AS ({raw_sql('duckdb')}),\nv_mates AS ({pairs_sql('duckdb')}),\nv_alleles AS ({ALLELES}),\nv_mate_reads AS ({MATES})"
