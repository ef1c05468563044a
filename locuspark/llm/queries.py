"""The queries of the subpackage, by name, and their SQL where it has one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm import bloom_lm, decontamination, html_text, lexical_search, line_templates, mixing, ngram_join, packing, pii, quality_rules, toxicity, whitening, winnowing

#: Key of the pseudonyms in the query; a deployment sets its own secret.
PII_KEY = "example key"


def tokenizer_folder() -> str:
    """Where the public vocabulary files are."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_folder()).drop("ids")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, out = bloom_lm.train_and_score(docs, ~bloom_lm.held_out(F.col("doc_id")))
    return out.select("doc_id", bloom_lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", *[c for c in out.columns if c.startswith("n_")])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    aside = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs.filter(~aside), labels.filter(~aside))
    out = toxicity.scored(docs, model, ["doc_id"])
    return out.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(table(spark, sf_dir, "documents"), copies=True).select("doc_id", "text", "n_dropped_lines")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "n_copies", "n_text_links", "n_links")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_winnowing, op2_mixing, op3_packing, op4_html, op5_bloom_lm, op6_pii, op7_toxicity, op8_quality, op9_line_templates, op10_ngram_join, op11_lexical_search, op12_whitening, op13_decontamination)}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP11_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_TERM}) AS terms FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW}, {_TERM})) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) x WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, st GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // l))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), st GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""

OP13_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_WORD}) AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(words[i:i + 9], ' ') AS win, least(len(words), 10) AS k FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0) x),
pos AS (SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) y) x),
met AS (SELECT doc_id, pos.k, i, item_id FROM pos JOIN win ON pos.k = win.k AND pos.win = win.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) x GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) x GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""

#: The other operators are beyond SQL as a whole; tests/llm holds the brute-force versions.
ORACLES: dict[str, str] = {"op11_lexical_search": OP11_SQL, "op13_decontamination": OP13_SQL}
