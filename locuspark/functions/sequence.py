"""Functions Column -> Column on sequences over ACGTN and on Phred strings.

All are built-in expressions, so they stay inside whole-stage code generation
or the interpreted higher-order functions; only ``find_adapter`` calls Python
(Arrow and numpy).  A null input gives a null result, but for ``find_adapter``.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC nucleotide codes and the bases each stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Bases of one word of a bit plane.
WORD = 60
#: Bases of one number of ``codes``.
CODED = 20
#: Most numbers of ``codes`` of which a distance is spelled out one by one.
SPELLED = 15
#: Letters that are searched for adapters at a time, in blocks of whole reads.
BLOCK = 1 << 20


def iupac_expand(pattern: str) -> list[str]:
    """All plain sequences a pattern stands for, in alphabetical order of the codes' bases."""
    return ["".join(p) for p in product(*(IUPAC[c] for c in pattern.upper()))]


def iupac_variants(s: Column) -> Column:
    """The same of a column of patterns; null with a letter that is no code."""
    codes = F.create_map(*[F.lit(x) for code, bases in IUPAC.items() for x in (code, ",".join(bases))])
    bases = lambda c: F.split(F.element_at(codes, c), ",")
    return F.aggregate(chars(F.upper(s)), F.array(F.lit("")), lambda done, c: F.flatten(F.transform(done, lambda x: F.transform(bases(c), lambda b: F.concat(x, b)))))


def iupac_regex(pattern: str) -> str:
    """A regular expression for a pattern."""
    return "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in pattern.upper())


def revcomp(s: Column) -> Column:
    """Reverse complement; N stays."""
    return F.translate(F.reverse(s), "ACGTacgt", "TGCAtgca")


def chars(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def n_expand(s: Column) -> Column:
    """All sequences with each N replaced by a base."""
    return F.aggregate(
        chars(s), F.array(F.lit("")), lambda done, c: F.flatten(F.transform(F.when(c == "N", F.array(*map(F.lit, "ACGT"))).otherwise(F.array(c)), lambda b: F.transform(done, lambda a: F.concat(a, b))))
    )


def _plane(s: Column, to: str) -> Column:
    bits = F.translate(s, "ACGTN", to)
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / WORD) - 1, F.lit(0)).cast("int"))
    return F.transform(at, lambda k: F.coalesce(F.conv(F.substr(bits, k * WORD + 1, F.lit(WORD)), 2, 10).cast("long"), F.lit(0).cast("long")))


def planes(s: Column) -> Column:
    """Bit planes of a sequence: two bits a base, and one that marks N."""
    return F.struct(_plane(s, "00110").alias("hi"), _plane(s, "01010").alias("lo"), _plane(s, "00001").alias("n"))


def planes_distance(a: Column, b: Column, ignore_n: bool) -> Column:
    """Mismatches between sequences of equal length, from their bit planes."""
    differ = F.zip_with(F.zip_with(a["hi"], b["hi"], lambda x, y: x.bitwiseXOR(y)), F.zip_with(a["lo"], b["lo"], lambda x, y: x.bitwiseXOR(y)), lambda x, y: x.bitwiseOR(y))
    if ignore_n:
        masked = F.zip_with(F.zip_with(a["n"], b["n"], lambda x, y: F.bitwise_not(x.bitwiseOR(y))), differ, lambda m, d: m.bitwiseAND(d))
    else:
        masked = F.zip_with(F.zip_with(a["n"], b["n"], lambda x, y: x.bitwiseXOR(y)), differ, lambda m, d: m.bitwiseOR(d))
    return F.aggregate(masked, F.lit(0), lambda s, x: s + F.bit_count(x))


def codes(s: Column) -> Column:
    """A sequence as whole numbers, three bits a base and ``CODED`` bases a number; without a lambda up to three of them."""

    def number(k: Column | int) -> Column:
        part = F.substr(s, F.lit(1) + k * CODED, F.lit(CODED))
        return F.coalesce(F.conv(F.translate(part, "ACGTN", "01234"), 8, 10).cast("long"), F.lit(0).cast("long"))

    few = F.when(F.length(s) <= CODED, F.array(number(0))).when(F.length(s) <= 2 * CODED, F.array(number(0), number(1))).when(F.length(s) <= 3 * CODED, F.array(number(0), number(1), number(2)))
    return few.when(s.isNotNull(), F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / CODED).cast("int") - 1), number))


def codes_distance(a: Column, b: Column, ignore_n: bool, most: int | None = None) -> Column:
    """Mismatches between sequences of equal length, from their codes.

    With the ``most`` numbers a code has, each of them is spelled out (up to
    ``SPELLED``); so there is no lambda, and a join can be compiled with the distance.
    """
    ones = F.lit((8**CODED - 1) // 7)

    def wrong(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        differ = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2))
        if ignore_n:
            differ = differ.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(x.bitwiseOR(y), 2)))
        return F.bit_count(differ.bitwiseAND(ones))

    def first(n: int) -> Column:
        return reduce(add, [F.coalesce(wrong(F.get(a, F.lit(k)), F.get(b, F.lit(k))), F.lit(0)) for k in range(1, n)], wrong(F.get(a, F.lit(0)), F.get(b, F.lit(0))))

    if most is not None and most <= SPELLED:
        return first(most)
    more = F.aggregate(F.zip_with(F.slice(a, F.lit(3), F.size(a)), F.slice(b, F.lit(3), F.size(b)), wrong), F.lit(0), lambda t, x: t + x)
    return F.when(F.size(a) <= 3, first(3)).otherwise(F.lit(0) + more + wrong(a[0], b[0]) + wrong(a[1], b[1]))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches; N is a letter like others, and what one sequence lacks differs."""
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))


def hamming_ignore_n(a: Column, b: Column) -> Column:
    """Mismatches at positions where neither sequence has N."""
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when((x == y) | (x == "N") | (y == "N"), 0).otherwise(1)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))


def mismatch_prefix(s: Column, pattern: str) -> Column:
    """Mismatches of a plain pattern to the start of s; missing letters mismatch."""
    return reduce(add, [F.when(F.substring(s, i + 1, 1) == c, 0).otherwise(1) for i, c in enumerate(pattern)], F.lit(0))


def simplify_header(header: Column, read_number: int) -> Column:
    """``@`` and header fields 3 to 6 and the read number, joined by ``_``."""
    fields = F.split(F.regexp_replace(F.trim(header), r"\s+", ":"), ":")
    return F.concat(F.lit("@"), F.array_join(F.concat(F.slice(fields, 4, 4), F.array(F.lit(str(read_number)))), "_"))


def scores(qual: Column, offset: int = 33) -> Column:
    """Phred scores of a quality string."""
    return F.transform(chars(qual), lambda c: F.ascii(c) - offset)


def sliding_quality(qual: Column, window: int, least: int, offset: int = 33) -> Column:
    """Whether no window has a mean score below ``least``; a shorter read is one window.

    Sums of windows are spelled out, so a read takes a lambda a letter and a start, and none a letter of a window.
    """
    n, least = F.length(qual), least + offset

    def fine(codes: Column) -> Column:
        def low(i: Column) -> Column:
            return reduce(add, [codes[i + k] for k in range(window)], F.lit(0)) < least * window

        return F.when(n < window, F.aggregate(codes, F.lit(0), lambda t, x: t + x) >= least * n).otherwise(~F.exists(F.sequence(F.lit(0), n - window), low))

    return F.when(n == 0, F.lit(True)).otherwise(bound(F.transform(chars(qual), lambda c: F.ascii(c)), fine))


def trunc_to(s: Column, n: Column | int) -> Column:
    """The first n letters; all of them if there are no more."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.substr(s, F.lit(1), F.greatest(n, F.lit(0)))


def site_starts(s: Column, sites: list[str]) -> Column:
    """Whether s begins with one of the plain sites."""
    return reduce(lambda a, b: a | b, [s.startswith(x) for x in sites])


def _nearest(s: Column, sites: list[str]) -> Column:
    """Struct (mismatches, order, site) of the site nearest to the start of s; ties to the first."""
    return F.least(*[F.struct(mismatch_prefix(s, x).alias("m"), F.lit(i).alias("i"), F.lit(x).alias("site")) for i, x in enumerate(sites)]) if len(sites) > 1 else F.struct(mismatch_prefix(s, sites[0]).alias("m"), F.lit(0).alias("i"), F.lit(sites[0]).alias("site"))


def site_repair(s: Column, sites: list[str], most: int) -> Column:
    """s with its start overwritten by the nearest site, or null beyond ``most`` mismatches."""
    return bound(_nearest(s, sites), lambda best: F.when(best["m"] <= most, F.concat(best["site"], F.substr(s, F.length(best["site"]) + 1))))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _one_of(hits: list[tuple[Column, Column]]) -> Column:
    """The value whose condition holds, if exactly one does; else null."""
    found = F.filter(F.array(*[F.when(c, x) for x, c in hits]), lambda x: x.isNotNull())
    return bound(found, lambda f: F.when(F.size(f) == 1, f[0]))


def barcode_match(s: Column, barcodes: list[str], sites: list[str]) -> Column:
    """The barcode that, with a site, begins s; null unless exactly one does."""
    return _one_of([(F.lit(b), site_starts(s, [b + x for x in sites])) for b in barcodes])


def _rest(s: Column, pattern: str) -> Column:
    return F.substr(s, F.lit(len(pattern) + 1))


def barcode_repair(s: Column, barcodes: list[str], sites: list[str], barcode_most: int, site_most: int) -> Column:
    """Struct (barcode, seq): s with barcode and site repaired, if one barcode fits; else null.

    ``barcode_most`` and ``site_most`` are the mismatches allowed in each part.
    """

    def hit(b: str) -> tuple[Column, Column]:
        fixed = F.concat(F.lit(b), site_repair(_rest(s, b), sites, site_most))
        return F.struct(F.lit(b).alias("barcode"), fixed.alias("seq")), (mismatch_prefix(s, b) <= barcode_most) & (_nearest(_rest(s, b), sites)["m"] <= site_most)

    return _one_of([hit(b) for b in barcodes])


def site_length(s: Column, sites: list[str]) -> Column:
    """Length of the first site that begins s; null if none does."""
    return F.coalesce(*[F.when(s.startswith(x), F.lit(len(x))) for x in sites])


def internal_site(s: Column, sites: list[str]) -> Column:
    """Whether a site occurs anywhere in s."""
    return s.rlike("|".join(sites))


def _starts_in(texts: list[str], adapters: list[str], rate: float, least_overlap: int) -> np.ndarray:
    """0-based starts of the leftmost adapter in each text, or -1; all texts are compared at once."""
    n = np.fromiter(map(len, texts), "int64", len(texts))
    ends, total = np.cumsum(n), int(n.sum())
    owner = np.repeat(np.arange(len(texts)), n)
    left = np.repeat(ends, n) - np.arange(total)
    found = np.full(len(texts), total, "int64")
    for adapter in adapters:
        a = len(adapter)
        letters = np.frombuffer(("".join(texts) + "\0" * a).encode("utf-32-le", "surrogatepass"), "<u4")
        wrong = np.zeros(total, "int32")
        for k, c in enumerate(adapter):
            wrong += (letters[k : k + total] != ord(c)) & (left > k)
        most = np.array([math.floor(float(rate) * k) for k in range(a + 1)])
        at = np.flatnonzero((left >= least_overlap) & (wrong <= most[np.minimum(left, a)]))[::-1]
        first = np.full(len(texts), total, "int64")
        first[owner[at]] = at - (ends - n)[owner[at]]
        found = np.minimum(found, first)
    return np.where(found == total, -1, found)


def find_adapter(s: Column, adapters: list[str], rate: float, least_overlap: int = 5) -> Column:
    """0-based start of the leftmost adapter, or -1.

    A start fits if the overlap of adapter and rest of the read, at least
    ``least_overlap`` letters, has at most rate times its length mismatches.
    """

    @F.pandas_udf("int")
    def starts(reads: pd.Series) -> pd.Series:
        texts = reads.where(reads.notna(), "").tolist()
        # Blocks of whole reads, so that long ones take no more memory.
        block = 1 + BLOCK // (1 + max(map(len, texts), default=0))
        parts = [_starts_in(texts[i : i + block], adapters, rate, least_overlap) for i in range(0, len(texts), block)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="int32")

    return starts(s)


def concat_revcomp(f: Column, r: Column) -> tuple[Column, Column]:
    """Both reads cut to the shorter length, joined as f and revcomp(r), and its reverse complement."""
    n = F.least(F.length(f), F.length(r))
    whole = F.concat(F.substr(f, F.lit(1), n), revcomp(F.substr(r, F.lit(1), n)))
    return whole, revcomp(whole)


def fragments(s: Column, d: Column) -> Column:
    """d + 1 fragments that do not overlap; the last one takes the rest."""
    step = F.floor(F.length(s) / (d + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), d), lambda k: F.when(k == d, F.substr(s, k * step + 1)).otherwise(F.substr(s, k * step + 1, step)))


def half_overlaps(s: Column, least: int, most: int) -> Column:
    """Lengths o for which the first half ends as the second begins, and 0."""
    h = F.floor(F.length(s) / 2).cast("int")
    a, b = F.substr(s, F.lit(1), h), F.substr(s, h + 1)
    return F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(least), F.lit(most)), lambda o: F.substr(a, h - o + 1) == F.substr(b, F.lit(1), o)))


def column_letters(seqs: Column, p: Column) -> Column:
    """Distinct letters at position p (from 0) of the sequences, sorted."""
    return F.array_sort(F.array_distinct(F.transform(seqs, lambda s: F.substr(s, p + 1, F.lit(1)))))


def var_positions(seqs: Column) -> Column:
    """Positions (from 0) where the sequences do not all have the same letter."""
    return F.when(F.size(seqs) > 0, F.filter(F.sequence(F.lit(0), F.length(seqs[0]) - 1), lambda p: F.size(column_letters(seqs, p)) > 1)).otherwise(F.array().cast("array<int>"))


def iupac_code(letters: Column) -> Column:
    """The code of a sorted set of letters; N for four bases or with N."""
    joined = F.array_join(letters, "")
    return F.coalesce(*[F.when(joined == v, F.lit(k)) for k, v in IUPAC.items() if k != "N"], F.lit("N"))


def consensus_iupac(seqs: Column) -> Column:
    """One letter a position: the code of the letters found there."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(seqs[0]) - 1), lambda p: iupac_code(column_letters(seqs, p))), "")


def consensus_n_resolve(seqs: Column) -> Column:
    """One letter a position: the base found there besides N, N if there is none."""
    return F.when(F.size(seqs) == 1, seqs[0]).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.length(seqs[0]) - 1), lambda p: F.coalesce(F.array_max(F.filter(column_letters(seqs, p), lambda c: c != "N")), F.lit("N"))), ""))


def var_chars(s: Column, positions: Column) -> Column:
    """The letters of s at positions (from 0)."""
    return F.array_join(F.transform(positions, lambda p: F.substr(s, p + 1, F.lit(1))), "")


def varpos_text(positions: Column) -> Column:
    """Positions as written in tables: ``p:`` and 1-based positions joined by ``/``."""
    return F.when(F.size(positions) == 0, F.lit("NA")).otherwise(F.concat(F.lit("p:"), F.array_join(F.transform(positions, lambda p: (p + 1).cast("string")), "/")))
