"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm import line_templates, mixing, ngram_join, packing, toxicity
from locuspark.llm.queries import tokenizer_folder
from locuspark.plans.naming import col
from locuspark.plans.scratch import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    A null or empty text has a score as any other; repeated rows are judged alike;
    without labels, or without documents, nothing is rejected; columns may have
    any names and come as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    aside = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs.filter(~aside), labels.filter(~aside))
    out = toxicity.scored(docs, model, docs.columns)
    return out.filter(col(out.columns[-1]) < toxicity.THRESHOLD).select(*[col(c) for c in docs.columns])


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur from other documents; ``n_chars`` follows the text.

    A null text stays null and an empty one empty; copies of one text keep and
    lose the same lines; an empty table stays empty; other columns come as they are.
    """
    out = line_templates.drop_recurring(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id.

    Null, empty and blank texts are one text each, so one of them stays; of
    repeated rows one stays; an empty table stays empty; columns come as they are.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one of its own; documents without words are taken in whole
    epochs only; equal rows share what the mix takes of them; an empty table stays
    empty; columns of any names come as they are.
    """
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens.

    A null or empty text is its end token alone; repeated rows are documents of
    their own; texts of any length are packed whole; an empty table gives no piece.
    """
    return packing.pack(docs, tokenizer_folder())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hash samples and token ids are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
