"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locuspark.queries import catalog_tables, chain, files, loci, reads
from locuspark.queries.fixtures import Fixture, duckdb_views

_PARTS = [reads.QUERIES, loci.QUERIES, catalog_tables.QUERIES, files.QUERIES, chain.QUERIES]


def _query(run: Callable[[Fixture], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(Fixture(spark, sf_dir))


def _sql(text: str) -> str:
    """``text``, either a SELECT or expressions and a SELECT, after the views."""
    lead = "WITH RECURSIVE " + duckdb_views()
    return f"{lead}\n{text}" if text.startswith("SELECT") else f"{lead},\n{text}"


QUERIES = {name: _query(run) for part in _PARTS for name, (run, _) in part.items()}
ORACLES = {name: _sql(text) for part in _PARTS for name, (_, text) in part.items() if text}
