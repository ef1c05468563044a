"""Benchmark decontamination by a prefix-filtered set join.

An item of the benchmark is cut into windows of ``WINDOW`` consecutive words; an
item of fewer words is one window.  A window is a set of shingles of up to
``SHINGLE`` neighbouring words, all of which a text must hold in place, so the
necessary prefix in the order of rarity is one shingle: the one that the corpus
holds least often.  The join goes by this shingle alone.  What it finds must fit
by position (the window begins at or after the text's first word) and length (it
ends at or before the last), and is then compared word by word.

The texts are read once.  Their shingles meet the 64-bit keys of the benchmark's
shingles in generated code; an occurrence is written with the words around it,
so counting, joining and verifying need no text.  Texts go by their MD5 from
there on, so copies are joined once.  Keys are broadcast in blocks of at most
``KEYS`` (8 bytes each); a larger benchmark is met block by block, each by a scan
of its own, so nothing is left out.

Defined cases: words are lower-cased in A-Z alone; a null or empty text has no
words and no hits; an item without words has no window; an item with a null id
counts and is listed as an empty string; rows of one item id are one item; rows
of documents, repeated or not, each give a row; texts of any length are read
whole; an empty benchmark hits nothing, an empty corpus gives an empty table;
other columns are of no account, and ids may be of any type and name.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.plans.naming import col, fresh
from locuspark.plans.scratch import materialize

WINDOW = 10
SHINGLE = 3
#: Most keys of shingles that are broadcast at once.
KEYS = 1 << 20
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # ``lower`` is right, and faster, where no letter lies beyond ASCII.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, APART), "")


def _key(size: int, word_at) -> Column:
    """The key of the shingle of ``size`` words; ``word_at(i)`` is its i-th."""
    return F.xxhash64(F.lit(size), *[word_at(i) for i in range(size)])


def windows_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, window, words, size): every window of every item once; size is that of its shingles."""
    items = benchmark.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("item"), words(col(text_col)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (WINDOW - 1), F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, WINDOW))).alias("words"))
    return each.select("item", F.xxhash64("words").alias("window"), "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("size")).distinct()


def _shingles(windows: DataFrame) -> DataFrame:
    """(window, offset, key) of the shingles of different windows."""

    def keys(m: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("words") - m), lambda i: _key(m, lambda t: F.get("words", i + t)))

    own = F.coalesce(*[F.when(F.col("size") == m, keys(m)) for m in range(1, SHINGLE + 1)])
    return windows.dropDuplicates(["window"]).select("window", F.posexplode(own).alias("offset", "key"))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], keys: DataFrame) -> DataFrame:
    """One row with ``head`` for each document, and the occurrences of the keys with the words around."""
    rows = docs.select(col(id_col).alias("id"), F.md5(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("same"), words(col(text_col)).alias("all"))
    each = rows.select("id", "same", "all", F.size("all").alias("n"), F.posexplode_outer("all").alias("pos", "word"))
    made = [_key(m, lambda t: F.col("word") if t == 0 else F.get("all", F.col("pos") + t)) for m in sizes]
    head = F.col("pos").isNull() | (F.col("pos") == 0)
    if len(sizes) == 1:
        each = each.select("*", made[0].alias("key"), head.alias("head"))
    else:
        each = each.select("*", F.posexplode(F.array(*made)).alias("nth", "key")).withColumn("head", head & (F.col("nth") == 0))
    found = each.join(F.broadcast(keys.withColumn("known", F.lit(True))), "key", "left").filter("known or head")
    around = F.when(F.col("known") & F.col("pos").isNotNull(), F.slice("all", F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0)) + 1, 2 * WINDOW - 1))
    return found.select("head", F.when(F.col("head"), F.col("id")).alias("id"), "same", "n", "pos", "key", around.alias("around"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = KEYS) -> DataFrame:
    """For each row of ``docs`` the words that windows of the benchmark hit.

    Columns: the id, n_words, n_hit, hits (start and length in words of every
    occurrence of a window, in order) and items (ids of the items with an
    occurring window, sorted as strings).  ``block`` bounds the keys that are
    broadcast at once.
    """
    windows = materialize(windows_of(benchmark, item_col, item_text_col))
    shingles = materialize(_shingles(windows))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [SHINGLE]
    keys = materialize(shingles.select("key").distinct())
    n_blocks = max(1, math.ceil(keys.count() / block))
    found = None
    for i in range(n_blocks):
        some = _occurrences(docs, id_col, text_col, sizes, keys.filter(F.pmod("key", F.lit(n_blocks)) == i))
        found = some if found is None else found.unionByName(some.filter("around is not null").withColumn("head", F.lit(False)))
    found = materialize(found)

    known = found.filter("around is not null").select("same", "n", "pos", "key", "around")
    counts = known.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # Windows with a shingle that the corpus lacks occur nowhere.
    rarest = shingles.join(counts, "key", "left").groupBy("window").agg(F.min(F.struct("n", "offset", "key")).alias("least"), F.count_if(F.col("n").isNull()).alias("missing"))
    prefix = rarest.filter("missing = 0").select("window", "least.offset", "least.key").join(windows.dropDuplicates(["window"]).select("window", "words"), "window")
    met = known.join(materialize(prefix), "key").withColumn("start", F.col("pos") - F.col("offset"))
    met = met.filter((F.col("start") >= 0) & (F.col("start") + F.size("words") <= F.col("n")))
    begin = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
    met = met.filter(F.slice("around", F.col("start") - begin + 1, F.size("words")) == F.col("words"))
    hits = materialize(met.select("same", "window", "start", F.size("words").alias("length")).distinct())

    ordered = F.sort_array(F.collect_list(F.struct("start", "length")))
    spans = hits.groupBy("same").agg(ordered.alias("hits"))
    end = lambda x: x["start"] + x["length"]
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), end(x) - F.greatest(a["to"], x["start"]))).alias("hit"), F.greatest(a["to"], end(x)).alias("to"))
    spans = spans.select("same", "hits", F.aggregate("hits", zero, step)["hit"].alias("n_hit"))
    items = hits.select("same", "window").distinct().join(windows.select("window", "item"), "window").select("same", "item").distinct()
    items = items.groupBy("same").agg(F.sort_array(F.collect_list("item")).alias("items"))
    texts = materialize(spans.join(items, "same"))

    rows = found.filter("head").select("id", "same", "n").join(texts, "same", "left")
    name = fresh([id_col], "n_words", "n_hit", "hits", "items")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias(name[0]), F.coalesce("n_hit", F.lit(0)).cast("long").alias(name[1]),
        none("hits", "array<struct<start:int,length:int>>").alias(name[2]), none("items", "array<string>").alias(name[3]),
    )
