"""Document quality by weak supervision: rules vote, their accuracies are estimated.

Each rule looks at figures of a text and votes good (1), bad (-1) or abstains
(0), which says nothing.  Given the unseen quality y of a text the votes are
taken as independent, each rule having its own accuracy: how often its votes on
good texts, and how often those on bad texts, are bad ones.
Expectation-maximisation estimates these and the share of good texts from the
votes alone, over all texts that the base rules leave in question; it needs only
how often each pattern of votes occurs, which is one aggregation and at most 3
to the number of rules (19,683) rows.  The rules overlap (symbols, letters and
word length look at the same marks; capitals and function words at the same
words), so that each is measured by what the others say of the texts it votes
on.  The maximisation is constrained: rules are
written so as to spare good texts, and none is taken to vote against more than
``WRONG`` of those it votes on; without that, good and bad would not be told
apart by votes that mostly agree.  A text is kept if its posterior probability
of being good reaches ``KEEP``, whatever single rules say.

Figures, words being maximal runs of characters other than 0x20 and 0x09-0x0D:
word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``),
n_dup_lines (lines with a word that equal an earlier line) and n_repeat_words
(words in windows of three words that occur twice or more in the text).  For the
votes also: n_letters and n_capitals (letters, upper-case letters), n_bare (words
without a letter), n_lines (lines with a word), n_ended (those whose last
character other than a blank is one of ``ENDS``), n_function (different words
of ``FUNCTION_WORDS`` that occur as they are) and n_hidden (those that occur if
case and all but letters are left out).  Texts in other languages have none of
either, and the rule on function words then abstains.

All of it is DataFrame expressions.  Repeated windows are found by sorting the
window hashes of a text, so a long text costs n log n.

Defined cases: a null or empty text has no word and fails; repeated rows vote
each; texts of any length are read whole; an empty table gives no row; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.plans.naming import col
from locuspark.plans.scratch import materialize

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ENDS = ".!?:;\"'\u00bb\u201d\u2026)"
#: Frequent words of English, German, French and Spanish prose.
FUNCTION_WORDS = "the and of to in is that with for was der die und das ist nicht ein mit von den le la les des et un une est que dans el los las y en por con del se no".split()
KEEP = 0.5
#: Start values: probability of being good without and with a vote against.
START = (0.95, 0.2)
WRONG = 0.02
MIN_WORDS = 50
MAX_REPEATED = 0.5


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_bare", "n_lines", "n_ended", "n_function", "n_hidden")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words within three-word windows that occur at least twice."""

    def covered(places: Column) -> Column:
        # Sorted starts of windows: each covers three words, less what the next one covers too.
        n = F.size(places)
        gaps = F.zip_with(F.slice(places, 1, F.greatest(n - 1, F.lit(0))), F.slice(places, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(n == 0, 0).otherwise(F.aggregate(gaps, F.lit(0), lambda s, x: s + x) + 3)

    def places(sorted_: Column) -> Column:
        n = F.size(sorted_)
        before = F.concat(F.array(F.lit(None).cast(sorted_type)), F.slice(sorted_, 1, n - 1))
        after = F.concat(F.slice(sorted_, 2, n - 1), F.array(F.lit(None).cast(sorted_type)))
        flags = F.zip_with(F.zip_with(before, sorted_, lambda a, b: F.struct(F.coalesce(a["h"] == b["h"], F.lit(False)).alias("twin"), b["i"].alias("i"), b["h"].alias("h"))), after, lambda s, a: F.when(s["twin"] | F.coalesce(a["h"] == s["h"], F.lit(False)), s["i"]))
        return F.sort_array(F.filter(flags, lambda x: x.isNotNull()))

    sorted_type = "struct<h:bigint,i:int>"

    def from_hashes(h: Column) -> Column:
        some = F.size(F.array_distinct(h)) < F.size(h)
        keyed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i")))
        return F.when(some, bound(F.sort_array(keyed), lambda s: bound(places(s), covered))).otherwise(0)

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        return F.zip_with(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(w, 3, n), lambda a, b: F.xxhash64(a, b))

    return F.when(F.size(words) < 4, 0).otherwise(bound(words, lambda w: bound(windows(w), from_hashes)))


def figures(text: Column) -> dict[str, Column]:
    """The figures of a text that need no list of its words."""
    letters = F.regexp_replace(text, r"\P{L}+", "")
    return {
        "word_chars": F.length(F.regexp_replace(text, WHITE, "")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        "n_letters": F.length(letters),
        "n_capitals": F.length(F.regexp_replace(letters, r"\P{Lu}+", "")),
        "n_bare": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])")),
        "n_ended": F.regexp_count(text, F.lit(f"[{re.escape(ENDS)}][\\x20\\x09\\x0B-\\x0D]*+(?=\\n|\\z)")),
    }


def line_figures(text: Column) -> Column:
    """n_lines and n_dup_lines of a text."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda s: F.struct(F.size(s).alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).alias("n_dup_lines")))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the figures of each row."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), text.alias("text"))
    places = {k: f"_w.{k}" for k in ("n_words", "n_repeat_words", "n_function")} | {k: f"_l.{k}" for k in ("n_lines", "n_dup_lines")}
    words = F.filter(F.split(F.col("text"), WHITE), lambda w: w != "")
    function = F.array(*map(F.lit, FUNCTION_WORDS))
    by_word = bound(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_intersect(w, function)).alias("n_function")))
    hidden = F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\x20\x09-\x0D]+", "")), WHITE)
    rows = rows.select("id", *[c.cast("long").alias(k) for k, c in figures(F.col("text")).items()], F.size(F.array_intersect(hidden, function)).alias("n_hidden"), line_figures(F.col("text")).alias("_l"), by_word.alias("_w"))
    return rows.select(F.col("id").alias(id_col), *[F.col(places.get(k, k)).cast("long").alias(k) for k in FIGURES])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > int(100 * MAX_REPEATED) * n_words)


def votes() -> dict[str, Column]:
    """The rules: 1 good, -1 bad, 0 no vote."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    capitals = F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1))
    bare = F.col("n_bare") / n
    ended = F.col("n_ended") / lines
    mean = F.col("word_chars") / n
    marks = F.col("n_symbols") / n
    repeats = F.col("n_repeat_words") / n

    def three(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        # Texts shorter still have failed the base rules.
        "length": three(F.col("n_words") >= 100, F.col("n_words") < 70),
        "word_length": three(mean.between(3.0, 9.0), (mean < 2.5) | (mean > 11.0)),
        "symbols": three(marks < 0.05, marks > 0.2),
        "repeats": three(repeats < 0.2, repeats > 0.4),
        "lines": three(F.col("n_dup_lines") == 0, F.col("n_dup_lines") >= 3),
        "letters": three(bare < 0.1, bare > 0.3),
        "capitals": three(capitals < 0.15, capitals > 0.4),
        "line_ends": three(ended > 0.7, (ended < 0.3) & (lines >= 3)),
        "function_words": three(F.col("n_function") >= 3, (F.col("n_function") == 0) & (F.col("n_hidden") >= 2)),
    }


#: log(P(vote | good) / P(vote | bad)) of each rule, by vote; and the log odds of being good.
Verdict = tuple[float, list[dict[int, float]]]


def accuracies(patterns: list[tuple[tuple[int, ...], int]], good: list[float]) -> tuple[float, list[tuple[float, float]]]:
    """The maximisation step: the share of good texts, and of each rule the shares of bad votes among
    those on good texts and on bad ones; one vote of each kind is added to each."""
    total = sum(n for _, n in patterns)
    share = min(0.99, max(0.01, sum(n * p for (_, n), p in zip(patterns, good, strict=True)) / total))
    out = []
    for j in range(len(patterns[0][0])):
        seen = {(y, x): 1.0 for y in (0, 1) for x in (-1, 1)}
        for (v, n), p in zip(patterns, good, strict=True):
            if v[j]:
                seen[1, v[j]] += n * p
                seen[0, v[j]] += n * (1 - p)
        out.append((min(WRONG, seen[1, -1] / (seen[1, -1] + seen[1, 1])), seen[0, -1] / (seen[0, -1] + seen[0, 1])))
    return share, out


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> Verdict:
    """The log odds that expectation-maximisation finds, from counts of vote patterns.

    A rule that votes against good texts more often than against bad ones says
    nothing, so that good and bad cannot change places.
    """
    nothing = {x: 0.0 for x in (-1, 0, 1)}
    good = [START[-1 in v] for v, _ in patterns]
    verdict: Verdict = (0.0, [nothing for _ in (patterns[0][0] if patterns else ())])
    for _ in range(rounds if patterns else 0):
        share, rules = accuracies(patterns, good)
        steps = [{-1: math.log(a / b), 0: 0.0, 1: math.log((1 - a) / (1 - b))} if b > a else nothing for a, b in rules]
        verdict = (math.log(share / (1 - share)), steps)
        good = [posterior(v, verdict) for v, _ in patterns]
    return verdict


def posterior(v: tuple[int, ...], verdict: Verdict) -> float:
    """Probability that a text with these votes is good."""
    z = verdict[0] + sum(steps[x] for x, steps in zip(v, verdict[1], strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the figures, base_failed, quality (posterior) and kept of each row."""
    rows = materialize(measured(docs, id_col, text_col))
    rules = votes()
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    counted = rows.filter(~failed).select(*[c.alias(k) for k, c in rules.items()]).groupBy(*rules).count().collect()
    # An empty table has no pattern, and no row that a vote could change.
    start, steps = estimate(sorted((tuple(r[k] for k in rules), r["count"]) for r in counted))
    z = F.lit(start)
    for c, by_vote in zip(rules.values(), steps, strict=bool(steps)):
        z = z + F.when(c == 1, by_vote[1]).when(c == -1, by_vote[-1]).otherwise(by_vote[0])
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))
