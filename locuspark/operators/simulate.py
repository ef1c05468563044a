"""Simulated reads with known loci, alleles and genotypes, for testing the rest."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.functions.sequence import revcomp


@dataclass(frozen=True)
class Settings:
    """Numbers of individuals, loci, reads and mutations; error and N rates."""

    inds: int = 20
    loci: int = 1200
    reads: int = 40
    length: int = 120
    least_distance: int = 20
    mate: int = 80
    mutations: int = 6
    error: float = 0.001
    unknown: float = 0.0
    duplicates: int = 0
    indels: int = 200
    indel_length: int = 3
    both_strands: bool = False
    seed: int = 1


def sim_loci(s: Settings, rng: random.Random) -> list[str]:
    """Random sequences of equal composition, each ``least_distance`` from all others.

    An error if so many cannot be found in a hundred tries a locus.
    """
    found = np.zeros((s.loci, s.length), np.uint8)
    letters = list(("ACGT" * (s.length // 4 + 1))[: s.length])
    n = 0
    for _ in range(s.loci * 100):
        if n == s.loci:
            break
        rng.shuffle(letters)
        found[n] = np.frombuffer("".join(letters).encode(), np.uint8)
        if n == 0 or (found[:n] != found[n]).sum(axis=1).min() >= s.least_distance:
            n += 1
    if n < s.loci:
        raise ValueError(f"found {n} of {s.loci} loci that are {s.least_distance} apart")
    return [bytes(x).decode() for x in found]


def sim_alleles(locus: str, n: int, rng: random.Random) -> list[str]:
    """A sequence and up to n stepwise mutants, all different."""
    out = [locus]
    for _ in range(n):
        base = rng.choice(out)
        i = rng.randrange(len(base))
        new = base[:i] + rng.choice([c for c in "ACGT" if c != base[i]]) + base[i + 1 :]
        if new not in out:
            out.append(new)
    return out


def sim_duplicates(alleles: list[list[str]], n: int) -> list[list[str]]:
    """The first allele of n loci becomes a locus of its own."""
    moved = [[a[0]] for a in alleles[:n] if len(a) > 1]
    return [a[1:] if i < n and len(a) > 1 else a for i, a in enumerate(alleles)] + moved


def sim_indels(alleles: list[list[str]], s: Settings, rng: random.Random) -> list[list[str]]:
    """The first allele of some loci loses ``indel_length`` letters."""
    chosen = set(rng.sample(range(len(alleles)), min(s.indels, len(alleles))))
    out = []
    for i, a in enumerate(alleles):
        if i in chosen and len(a) > 1:
            at = rng.randrange(len(a[0]) - s.indel_length)
            a = [a[0][:at] + a[0][at + s.indel_length :], *a[1:]]
        out.append(a)
    return out


def sim_freqs(n_alleles: int, copies: int, rng: random.Random) -> list[int]:
    """Random numbers of copies that sum to ``copies``; two alleles at least, if there are two."""
    cuts = sorted(rng.randrange(copies + 1) for _ in range(n_alleles - 1))
    counts = [b - a for a, b in zip([0, *cuts], [*cuts, copies], strict=True)]
    if n_alleles > 1 and sum(c > 0 for c in counts) < 2:
        top = counts.index(max(counts))
        counts[top] -= 1
        counts[(top + 1) % n_alleles] += 1
    return counts


def sim_genotypes(counts: list[int], rng: random.Random) -> list[tuple[int, int]]:
    """Shuffled copies dealt to individuals, two each."""
    bag = [i for i, c in enumerate(counts) for _ in range(c)]
    rng.shuffle(bag)
    return list(zip(bag[::2], bag[1::2], strict=True))


def sim_database(spark: SparkSession, s: Settings) -> DataFrame:
    """(ind, poploc, popall, seq, copy): the true genotypes; small, made on the driver."""
    rng = random.Random(s.seed)
    alleles = sim_duplicates([sim_alleles(x, s.mutations, rng) for x in sim_loci(s, rng)], s.duplicates)
    alleles = sim_indels(alleles, s, rng)
    rows, first = [], 0
    for loc, own in enumerate(alleles):
        for ind, pair in enumerate(sim_genotypes(sim_freqs(len(own), 2 * s.inds, rng), rng)):
            rows += [(ind, loc + 1, first + a + 1, own[a], k) for k, a in enumerate(pair)]
        first += len(own)
    return spark.createDataFrame(rows, "ind int, poploc int, popall int, seq string, copy int")


def _place(c: Column) -> Column:
    """1 to 4 for A, C, G and T."""
    return F.coalesce(*[F.when(c == b, F.lit(i + 1)) for i, b in enumerate("ACGT")], F.lit(1))


def sim_reads(genotypes: DataFrame, s: Settings) -> DataFrame:
    """(ind, header, seq): reads of the genotypes, made in parallel by hashes.

    Each read takes one of the two copies; the mates are the ends of the
    allele, joined.  Letters are replaced at the error rate and by N at the
    rate of unknown ones.
    """
    two = genotypes.groupBy("ind", "poploc").agg(F.array_sort(F.collect_list(F.struct("copy", "popall", "seq"))).alias("c"))
    rows = two.select("ind", "poploc", "c", F.explode(F.sequence(F.lit(1), F.lit(s.reads))).alias("read"))
    key = ["ind", "poploc", "read"]

    def draw(salt: object) -> Column:
        return F.pmod(F.xxhash64(F.lit(s.seed), *[F.col(k) for k in key], salt), F.lit(1 << 30)) / (1 << 30)

    rows = rows.withColumn("a", F.element_at("c", (1 + F.pmod(F.xxhash64(F.lit(s.seed), *key), F.lit(2))).cast("int")))
    rows = rows.withColumn("whole", F.concat(F.substr("a.seq", F.lit(1), F.lit(s.mate)), F.substr("a.seq", F.greatest(F.length("a.seq") - s.mate + 1, F.lit(1))))) if s.length > 2 * s.mate else rows.withColumn("whole", F.col("a.seq"))
    if s.both_strands:
        rows = rows.withColumn("whole", F.when(draw(F.lit("strand")) < 0.5, revcomp(F.col("whole"))).otherwise(F.col("whole")))

    def letter(c: Column, i: Column) -> Column:
        other = F.substr(F.lit("ACGT"), (1 + F.pmod(_place(c) + F.floor(3 * draw(F.concat(F.lit("b"), i))), F.lit(4))).cast("int"), F.lit(1))
        return F.when(draw(F.concat(F.lit("n"), i)) < s.unknown, "N").when(draw(F.concat(F.lit("e"), i)) < s.error, other).otherwise(c)

    seq = F.array_join(F.transform(F.filter(F.split("whole", ""), lambda c: c != ""), letter), "")
    header = F.concat_ws("_", F.lit("@1"), "poploc", "a.popall", "read", F.lit("1"))
    return rows.select("ind", header.alias("header"), seq.alias("seq"))
