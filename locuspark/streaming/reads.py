"""Counting and demultiplexing of reads that keep arriving.

Both are the batch operators unchanged: demultiplexing is a stateless chain
of expressions, counting an aggregation whose state is one row an svar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from locuspark.operators import demux
from locuspark.operators.individual import svar_count


def count_svars(reads: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A table ``name`` with the svar counts so far."""
    return svar_count(reads).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def demultiplex(reads: DataFrame, settings: demux.Demux, path: str, checkpoint: str) -> StreamingQuery:
    """Reads written to Parquet folders by destination, each exactly once."""
    out = demux.single(reads, settings)
    return out.writeStream.outputMode("append").partitionBy("dest").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
