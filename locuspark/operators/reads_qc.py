"""Quality profiles and positional quality filters of reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.plans.naming import fresh
from locuspark.plans.scratch import materialize
from locuspark.sources import fastq


def phred_histogram(reads: DataFrame, keys: list[str], offset: int = 33) -> DataFrame:
    """(keys, pos, score, perc): percentage of the reads that have a score at a position (from 1).

    Pairs of neighbouring letters are counted first: half as many rows as letters,
    and no more different ones at a place than the square of the scores, so partial
    sums stay small.  Letters are parted in what remains.
    """
    at, word, k, n, total = fresh([*keys, "qual", "pos", "score"], "at", "word", "k", "n", "total")
    two = F.explode(F.sequence(F.lit(0), F.floor((F.length("qual") - 1) / 2).cast("int"))).alias(at)
    words = reads.filter("length(qual) > 0").select(*keys, "qual", two).select(*keys, at, F.substr(F.col("qual"), 2 * F.col(at) + 1, F.lit(2)).alias(word))
    counted = words.groupBy(*keys, at, word).agg(F.count(F.lit(1)).alias(n))
    each = counted.select(*keys, n, at, F.posexplode(S.scores(F.col(word), offset)).alias(k, "score"))
    found = each.groupBy(*keys, (2 * F.col(at) + F.col(k)).alias("pos"), "score").agg(F.sum(n).alias(n))
    reads_of = reads.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.count(F.lit(1)).alias(total))
    both = found.join(reads_of, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] or F.lit(True))
    return both.select(*keys, (F.col("pos") + 1).alias("pos"), "score", (100.0 * F.col(n) / F.col(total)).alias("perc"))


def phred_histogram_wide(hist: DataFrame, keys: list[str], scores: list[int]) -> DataFrame:
    """One row a position, one column a score, missing ones 0."""
    return hist.groupBy(*keys, "pos").pivot("score", scores).agg(F.sum("perc")).na.fill(0.0)


def passes(qual: Column, limits: list[tuple[int, int]], offset: int = 33) -> Column:
    """Whether every listed position (from 1) has at least its score; positions beyond the read pass."""
    tests = [(F.length(qual) < p) | (F.ascii(F.substring(qual, p, 1)) - offset >= least) for p, least in limits]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def phred_pos_filter(reads: DataFrame, limits: list[tuple[int, int]], offset: int = 33) -> DataFrame:
    return reads.filter(passes(F.col("qual"), limits, offset))


def phred_pos_filter_pair(pairs: DataFrame, forward: list[tuple[int, int]], reverse: list[tuple[int, int]], offset: int = 33) -> DataFrame:
    """Pairs (f_qual, r_qual) of which both mates pass."""
    return pairs.filter(passes(F.col("f_qual"), forward, offset) & passes(F.col("r_qual"), reverse, offset))


def phred_filter_report(reads: DataFrame, key: str, limits: list[tuple[int, int]], offset: int = 33) -> DataFrame:
    """(key, n_seq, n_bad, prop_bad, n_good)."""
    r = reads.groupBy(key).agg(F.count(F.lit(1)).alias("n_seq"), F.count_if(~passes(F.col("qual"), limits, offset)).alias("n_bad"))
    return r.select(key, "n_seq", "n_bad", (F.col("n_bad") / F.col("n_seq")).alias("prop_bad"), (F.col("n_seq") - F.col("n_bad")).alias("n_good"))


def write_filtered(reads: DataFrame, limits: list[tuple[int, int]], path: str, key: str, compress: bool = False, offset: int = 33) -> DataFrame:
    """Writes the reads that pass as FASTQ, in a folder for each value of ``key``; gives the report of the filter.

    Nothing is shuffled for the files: every task writes what passes of its reads.
    """
    fastq.write(phred_pos_filter(reads, limits, offset), path, [key], compress)
    return phred_filter_report(reads, key, limits, offset)


def write_filtered_pairs(pairs: DataFrame, forward: list[tuple[int, int]], reverse: list[tuple[int, int]], path: str, key: str, compress: bool = False, offset: int = 33) -> DataFrame:
    """The same for mates (f_ and r_ of header, seq and qual), in folders ``f`` and ``r``: pairs of which both pass.

    The pairs are written once before, so both sides come from the same parts and
    mates stand at the same place of files of the same number.
    """
    good = materialize(phred_pos_filter_pair(pairs, forward, reverse, offset))
    for side in "fr":
        fastq.write(good, f"{path}/{side}", [key], compress, f"{side}_header", f"{side}_seq", f"{side}_qual")
    n = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_seq"))
    kept = good.groupBy(key).agg(F.count(F.lit(1)).alias("n_good"))
    r = n.join(kept, key, "left").withColumn("n_good", F.coalesce("n_good", F.lit(0)))
    return r.select(key, "n_seq", (F.col("n_seq") - F.col("n_good")).alias("n_bad"), (1 - F.col("n_good") / F.col("n_seq")).alias("prop_bad"), "n_good")
