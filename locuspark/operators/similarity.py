"""Pairs of sequences within a bounded Hamming distance, without a cross join.

A sequence is cut into d + 1 fragments; two sequences with at most d
mismatches have at least one fragment in common.  Fragments are joined by
equality, and the distance is checked on codes.

A fragment that very many sequences share (the remnant of a restriction site)
is no key.  Cut into d + 2 fragments, the same two sequences have two in
common, so sequences with such a heavy fragment are joined by pairs of those.
Groups that are heavy even then are dealt in pairs of blocks, so no task gets a
group that grows with the data, and no pair is lost.

Where few sequences have equal keys and length, all of them are compared with each
other: that takes less than to sort each one's fragments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.functions import sequence as S
from locuspark.plans.scratch import materialize

#: A fragment with more N than this is compared with all sequences of its group.
MOST_N = 3
#: A key is heavy if the sequences of both sides that share it are, multiplied, more than the square of this.
HEAVY = 2000
#: Groups are compared as a whole if their sizes, multiplied, are at most the square of ``HEAVY`` divided by this.
SMALL = 20


def _n_count(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, "N", ""))


def _rows(df: DataFrame, keys: list[str], seq: str, d: Column, carry: list[str] | None = None) -> DataFrame:
    """(keys, sl, seq, planes, d, carry) of each different sequence; ``planes`` are the codes distances are worked out from."""
    return df.select(*keys, F.col(seq).alias("seq"), F.length(seq).alias("sl"), d.cast("int").alias("d"), *(carry or [])).distinct().withColumn("planes", S.codes(F.col("seq")))


def _is_wide() -> Column:
    """Whether a sequence has a fragment, by either cut, of more than ``MOST_N`` N."""
    many = lambda d: F.exists(S.fragments(F.col("seq"), d), lambda x: _n_count(x) > MOST_N)
    return (_n_count(F.col("seq")) > MOST_N) & (many(F.col("d")) | many(F.col("d") + 1))


def _wide(rows: DataFrame) -> DataFrame:
    return rows.filter(_is_wide())


def _expanded(fragment: Column, ignore_n: bool) -> Column:
    """The keys of a fragment: itself, or all it stands for; none with too many N, which ``_wide`` has."""
    if not ignore_n:
        return F.array(fragment)
    return F.when(_n_count(fragment) == 0, F.array(fragment)).when(_n_count(fragment) > MOST_N, F.array().cast("array<string>")).otherwise(S.n_expand(fragment))


def _by_bases(df: DataFrame, name: str) -> DataFrame:
    """Rows once for each sequence that the fragment in ``name`` stands for, N after N; those with too many N, which ``_wide`` has, go."""
    df, c = df.filter(_n_count(F.col(name)) <= MOST_N), F.col(name)
    for _ in range(MOST_N):
        each = F.array(*[F.overlay(c, F.lit(x), F.locate("N", c)) for x in "ACGT"])
        df = df.withColumn(name, F.explode(F.when(c.contains("N"), each).otherwise(F.array(c))))
    return df


def _pieces(rows: DataFrame, keys: list[str], ignore_n: bool) -> DataFrame:
    """(keys, sl, seq, planes, d, k, piece) by the cut into d + 1 fragments, as ``S.fragments`` cuts."""
    step = F.floor(F.col("sl") / (F.col("d") + 1)).cast("int")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), "d")).alias("k"))
    start = F.col("k") * step + 1
    each = each.withColumn("piece", F.when(F.col("k") == F.col("d"), F.substr("seq", start)).otherwise(F.substr("seq", start, step)))
    return _by_bases(each, "piece") if ignore_n else each


def _double_pieces(rows: DataFrame, keys: list[str], ignore_n: bool) -> DataFrame:
    """The same by pairs of the cut into d + 2 fragments."""
    each = rows.select("*", S.fragments(F.col("seq"), F.col("d") + 1).alias("all"))
    each = each.select("*", F.posexplode("all").alias("i", "first")).select("*", F.posexplode("all").alias("j", "second")).filter("i < j")
    two = F.flatten(F.transform(_expanded(F.col("first"), ignore_n), lambda x: F.transform(_expanded(F.col("second"), ignore_n), lambda y: F.concat_ws("|", x, y))))
    return each.select(*rows.columns, (F.col("i") * (F.size("all") + 1) + F.col("j")).alias("k"), F.explode(two).alias("piece"))


def heavy_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on, l_blocks, r_blocks) of the keys that join too many rows."""
    n = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    both = n(left, "l").withColumn("r", F.col("l")) if left is right else n(left, "l").join(n(right, "r"), on)
    return materialize(both.filter(F.col("l") * F.col("r") > HEAVY * HEAVY).select(*on, F.ceil(F.col("l") / HEAVY).cast("int").alias("l_blocks"), F.ceil(F.col("r") / HEAVY).cast("int").alias("r_blocks")))


def blocked(pieces: DataFrame, heavy: DataFrame, on: list[str], own: str, other: str, by: str = "seq") -> DataFrame:
    """Rows of heavy keys in a block of their own side, once for each block of the other; rows of other keys as they are."""
    rows = pieces.join(heavy, on, "left")
    block = F.pmod(F.xxhash64(by), F.coalesce(own, F.lit(1)))
    rows = rows.withColumn("block", block).withColumn("meets", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
    return rows.drop("l_blocks", "r_blocks")


def _sizes(rows: DataFrame, keys: list[str], ignore_n: bool) -> DataFrame:
    """(keys, sl, n, wide): sequences of each group of one length, and whether any is wide."""
    wide = _is_wide() if ignore_n else F.lit(False)
    return rows.groupBy(*keys, "sl").agg(F.count(F.lit(1)).alias("n"), F.max(wide).alias("wide"))


def _figures(sizes: DataFrame) -> tuple[int, int, int, bool]:
    """Sequences of the smallest and of the largest group, letters of the longest one, and whether any is wide: one row to the driver."""
    least, n, longest, wide = sizes.agg(F.min("n"), F.max("n"), F.max("sl"), F.max("wide")).first()
    return least or 0, n or 0, longest or 0, bool(wide)


def dealt(left: DataFrame, right: DataFrame, keys: list[str], ignore_n: bool, most: int | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of tables (keys, sl, seq, planes, d, k, piece, block, meets) of rows to join.

    ``most`` is the largest product of the sizes of two groups of sequences of
    one length.  A sequence has a key once, so if that is not too much, no key is
    heavy and none is counted.
    """
    on = [*keys, "sl", "k", "piece"]
    same = left is right
    plain = lambda df: df.withColumn("block", F.lit(0).cast("long")).withColumn("meets", F.lit(0))
    if most is not None and most <= HEAVY * HEAVY:
        return [(plain(_pieces(left, keys, ignore_n)), plain(_pieces(right, keys, ignore_n)))]
    lp = materialize(_pieces(left, keys, ignore_n))
    rp = lp if same else materialize(_pieces(right, keys, ignore_n))
    heavy = heavy_keys(lp, rp, on)
    if heavy.isEmpty():
        return [(plain(lp), plain(rp))]
    light = [plain(p.join(heavy, on, "left_anti")) for p in (lp, rp)]
    touched = lambda rows, p: rows.join(p.join(heavy, on, "left_semi").select(*keys, "seq").distinct(), [*keys, "seq"], "left_semi")
    ld = materialize(_double_pieces(touched(left, lp), keys, ignore_n))
    rd = ld if same else materialize(_double_pieces(touched(right, rp), keys, ignore_n))
    more = heavy_keys(ld, rd, on)
    return [(light[0], light[1]), (blocked(ld, more, on, "l_blocks", "r_blocks"), blocked(rd, more, on, "r_blocks", "l_blocks"))]


def _pairs(a: DataFrame, b: DataFrame, keys: list[str], ignore_n: bool, carry: list[str] | None = None) -> DataFrame:
    """(keys, sl, seq1, seq2, dist, carry) of all near pairs, with dist at most d of a, once each; the distance is exact.

    With ``a is b``, a pair comes in the order of its sequences only.  Pieces are
    joined by a number made of all that must be equal, so that rows are short and
    sorted fast; group and length are compared too, and whatever else meets by
    chance is a pair like others, as its distance is exact.

    Pieces are merged, not broadcast: their files say little of what they take in
    memory, and the work of a pair join lies in its output, which shuffled parts share.
    """
    group, single, more = [*keys, "sl"], [*keys, "sl", "k", "piece"], carry or []
    same = [F.col(c) == F.col(f"_{c}") for c in group]
    once = [F.col("seq1") < F.col("seq2")] if a is b else []
    sizes = _sizes(a, keys, ignore_n)
    others = sizes if a is b else _sizes(b, keys, ignore_n)
    least, n, longest, wide = _figures(sizes)
    fewest, m, other, also = (least, n, longest, wide) if a is b else _figures(others)
    words = max(1, -(-max(longest, other) // S.CODED))
    # Codes of few numbers are columns of their own, which are sorted and compared faster than arrays.
    flat = lambda name: [F.get("planes", F.lit(k)).alias(f"{name}_{k}") for k in range(words)] if words <= S.SPELLED else [F.col("planes").alias(name)]
    code = lambda name: F.array(*[F.col(f"{name}_{k}") for k in range(words)]) if words <= S.SPELLED else F.col(name)
    dist = S.codes_distance(code("p1"), code("p2"), ignore_n, words)
    right_of = lambda df, key: df.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("seq").alias("seq2"), *flat("p2"), *more, key.alias("_key"))
    left_of = lambda df, key: df.select(*group, F.col("seq").alias("seq1"), *flat("p1"), F.col("d").alias("most"), key.alias("key"))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        met = left.join(right.hint("merge"), [F.col("key") == F.col("_key"), *same, *once])
        return met.select(*group, "seq1", "seq2", "most", *more, dist.alias("dist")).filter("dist <= most").drop("most")

    whole = F.xxhash64(*group)
    few = (HEAVY // SMALL) ** 2
    if n * m <= few:
        return near(left_of(a, whole), right_of(b, whole))
    found = []
    if least * fewest <= few:
        counted = others.select(*group, F.col("n").alias("m")) if a is not b else None
        met = sizes.withColumn("m", F.col("n")) if counted is None else sizes.join(counted.hint("merge"), group)
        large = materialize(met.filter(F.col("n") * F.col("m") > few).select(*group))
        found.append(near(left_of(a.join(large.hint("merge"), group, "left_anti"), whole), right_of(b.join(large.hint("merge"), group, "left_anti"), whole)))
        big = materialize(a.join(large.hint("merge"), group, "left_semi").select(*a.columns))
        a, b = big, big if a is b else materialize(b.join(large.hint("merge"), group, "left_semi").select(*b.columns))
    parts = []
    for left, right in dealt(a, b, keys, ignore_n, n * m):
        parts.append(near(left_of(left, F.xxhash64(*single, "block", F.col("meets").cast("long"))), right_of(right, F.xxhash64(*single, F.col("meets").cast("long"), "block"))))
    # Few sequences have so many N; each meets every sequence of its own group and length.
    if wide:
        parts.append(near(left_of(_wide(a), whole), right_of(b, whole)))
    if also:
        parts.append(near(left_of(a, whole), right_of(_wide(b), whole)))
    return reduce(DataFrame.unionByName, [*found, reduce(DataFrame.unionByName, parts).distinct()])


def similar_pairs(df: DataFrame, keys: list[str], seq: str, d: Column | int, ignore_n: bool) -> DataFrame:
    """All pairs (keys, sl, seq1 < seq2, dist) with dist at most d.

    ``d`` may depend on keys and length only.  Sequences of different length
    are never paired; repeated sequences count once.
    """
    d = F.lit(d) if isinstance(d, int) else d
    rows = materialize(_rows(df, keys, seq, d))
    return _pairs(rows, rows, keys, ignore_n).select(*keys, "sl", "seq1", "seq2", "dist")


def similar_between(a: DataFrame, b: DataFrame, keys: list[str], seq_a: str, seq_b: str, d: Column | int, ignore_n: bool, carry: list[str] | None = None) -> DataFrame:
    """All pairs (keys, sl, seq1 of a, seq2 of b, dist) with dist at most d of a; with the columns ``carry`` of b, of which a pair comes once for each different row."""
    if isinstance(d, int):
        left = materialize(_rows(a, keys, seq_a, F.lit(d)))
        right = materialize(_rows(b, keys, seq_b, F.lit(d), carry))
    else:
        left = materialize(_rows(a, keys, seq_a, d))
        own = left.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("sl").alias("_l"), F.col("d").alias("_most")).distinct()
        b2 = b.select(*keys, F.col(seq_b).alias("seq"), *(carry or [])).join(own.hint("merge"), [*[F.col(k) == F.col(f"_{k}") for k in keys], F.length("seq") == F.col("_l")])
        right = materialize(_rows(b2, keys, "seq", F.col("_most"), carry))
    return _pairs(left, right, keys, ignore_n, carry).select(*keys, "sl", "seq1", "seq2", "dist", *(carry or []))
