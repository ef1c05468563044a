"""Near-duplicate join: Jaccard likeness of word 5-gram sets, 0.8 or more.

1. Equal texts fold into one representative, which stands for the one with the
   least id.  (The sketch of step 2 is made of every row, before the fold, as
   that spares a shuffle of the texts.)
2. Each representative gets a signature of ``HASHES`` MinHash values.  Runs of
   ``ROWS`` values form ``BANDS`` band keys; a pair at the threshold shares
   none of them with probability (1 - 0.8**5)**32 = 3e-6.
3. Band keys held by several representatives link each of these to the least
   of them.  Candidates are compared within groups, and no pair is written out.
   A component of that graph is one group if it fits a block, or takes no more
   comparisons than its bands would: then each pair is met once.  If it takes
   more, as where chance links make a chain of unlike texts, each band key is a
   group, and a pair counts in the first band that it shares, so that the work is
   that of the bands however large a component grows.  Both ways find every pair
   that shares a band.
4. A group is dealt into blocks by a hash, as many as its size asks for, and
   each pair of blocks is one task's work: MinHash values of all its pairs are
   compared ``STEP`` at a time, and a pair is dropped as soon as the posterior
   probability (uniform prior) that its likeness reaches the threshold falls
   below ``TOLERANCE``.  The rest are verified exactly on their 5-gram sets.
   Only numbers of links and one spanning link a document leave the task.
5. Components of the spanning links are the classes.

Defined cases: a null text counts as empty; texts of the same words part by
part are compared as sets, and those of fewer than five words have their whole
word sequence as only 5-gram; texts without words are linked to equal texts
alone; rows with a null id are kept, each by its text; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from locuspark.llm.arrays import U64, blocks, buffers, mix, shingles, words
from locuspark.operators.components import connected_components
from locuspark.plans.naming import col, fresh
from locuspark.plans.scratch import materialize

K = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: Documents, and distinct 5-grams, that a block holds on average at most.
BLOCK_DOCS = 1000
BLOCK_GRAMS = 2_000_000
#: Comparisons within bands that are taken to cost as much as one within a component (texts travel once for each band).
BAND_COST = 1.0
#: Band number of a group that is a component.
WHOLE = -1
#: Tasks that the members of a group beyond one block go to while they are dealt.
SALTS = 32
#: Side of rows of a block that meets itself; else 0 and 1.
DIAGONAL = 2

_FACTORS = (mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes under odd 32-bit multipliers."""
    x = (grams >> U64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 256):
        np.minimum(out, (x[a : a + 256, None] * _FACTORS).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    s = sig.reshape(BANDS, ROWS).astype(U64)
    h = np.arange(1, BANDS + 1, dtype=U64)
    for t in range(ROWS):
        h = mix(h * U64(0x9E3779B97F4A7C15) + s[:, t])
    return h


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """(n, m): after n compared values, a pair with fewer than m equal ones is dropped.

    With a uniform prior and m of n equal, the posterior of the likeness is
    Beta(m + 1, n - m + 1); its mass from the threshold up is the probability
    that a binomial variable of n + 1 trials is at most m.
    """
    out = []
    for n in range(step, hashes + 1, step):
        p, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while True:
            total += p
            if total >= tolerance:
                break
            p *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append((n, m))
    return out


_LEAST = least_matches()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, same, text) to (id, same, n_grams, sig)."""
    for b in batches:
        data, at = buffers(b.column(2))
        sizes, sigs = [], []
        for i, j in blocks(at):
            h, edge = words(data, at, i, j)
            for k in range(j - i):
                g = np.unique(shingles(h[edge[k] : edge[k + 1]], K))
                sizes.append(len(g))
                sigs.append(signature(g).tobytes() if len(g) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "same", "n_grams", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig) to (node, band, at) for each band."""
    for b in batches:
        n = b.num_rows
        for a in range(0, n, 2000):
            part = b.slice(a, 2000)
            keys = [band_keys(np.frombuffer(s, np.uint32)) for s in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys)))], names=["node", "band", "at"])


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row of two arrays of signatures: the first band that they share."""
    out = np.full(len(a), BANDS)
    for c in range(0, len(a), 100_000):
        same = (a[c : c + 100_000] == b[c : c + 100_000]).reshape(-1, BANDS, ROWS).all(axis=2)
        out[c : c + 100_000] = np.where(same.any(axis=1), same.argmax(axis=1), BANDS)
    return out


def alike(a: np.ndarray, b: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures that survive all steps; within: of rows i < j of one block."""
    out_i, out_j = [], []
    step = max(1, 4_000_000 // max(1, len(b) * STEP))
    for s in range(0, len(a), step):
        rows = a[s : s + step]
        n, m = _LEAST[0]
        same = np.zeros((len(rows), len(b)), dtype=np.int16)
        for t in range(n):
            same += rows[:, t, None] == b[None, :, t]
        ok = same >= m
        if within:
            ok &= np.arange(s, s + len(rows))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(ok)
        got = same[i, j].astype(np.int64)
        last = n
        for n, m in _LEAST[1:]:
            if not len(i):
                break
            for c in range(0, len(i), 200_000):
                x, y = i[c : c + 200_000], j[c : c + 200_000]
                got[c : c + 200_000] += (rows[x, last:n] == b[y, last:n]).sum(axis=1)
            keep = got >= m
            i, j, got, last = i[keep], j[keep], got[keep], n
        out_i.append(i + s)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def verified(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sorted sets reach the threshold exactly."""
    ok = np.zeros(len(i), dtype=bool)
    order = np.argsort(i, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(order) else []:
        x = left[i[run[0]]]
        for p in run.tolist():
            y = right[j[p]]
            if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                continue
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            ok[p] = both >= threshold * (len(x) + len(y) - both) - 1e-9
    return ok


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, node, copies, sig, text, at), sorted by cell, to links of each node; at is the band of the group, if it has one."""
    cell: list[tuple] = []
    at = None

    def work() -> Iterator[pa.RecordBatch]:
        within = cell[0][1] == DIAGONAL
        sides = [[r for r in cell if r[1] in s] for s in ((0, DIAGONAL), (1,))]
        left, right = sides[0], sides[0] if within else sides[1]
        if not left or not right:
            return
        sigs = [np.array([np.frombuffer(r[4], np.uint32) for r in s]) for s in (left, right)]
        i, j = alike(sigs[0], sigs[1], within)
        if cell[0][6] != WHOLE and len(i):
            own = first_shared(sigs[0][i], sigs[1][j]) == cell[0][6]
            i, j = i[own], j[own]
        if not len(i):
            return
        need = [sorted({*i.tolist(), *(j.tolist() if within else ())}), sorted({*j.tolist()})]
        sets = [{k: _grams(s[k][5]) for k in n} for s, n in zip((left, right), need, strict=True)]
        if within:
            sets[1] = sets[0]
        ok = verified(i, j, sets[0], sets[1])
        i, j = i[ok], j[ok]
        if not len(i):
            return
        nodes = [r[2] for r in left] + ([] if within else [r[2] for r in right])
        copies = np.array([r[3] for r in left] + ([] if within else [r[3] for r in right]))
        j = j if within else j + len(left)
        n = len(nodes)
        links = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        docs = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        # A spanning link for each node: to the root of its part of this cell.
        root = list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        has = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array([nodes[k] for k in has], pa.int64()), pa.array(links[has].astype(np.int64)), pa.array(docs[has].astype(np.int64)), pa.array([nodes[find(k)] for k in has.tolist()], pa.int64())],
            names=["node", "links", "docs", "root"],
        )

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != at and cell:
                yield from work()
                cell = []
            at = row[0]
            cell.append(row)
    if cell:
        yield from work()


def _grams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h, _ = words(raw, np.array([0, len(raw)], np.int64), 0, 1)
    return np.unique(shingles(h, K))


def by_bands(members: DataFrame, linked: DataFrame) -> DataFrame:
    """The components of ``members`` (component, node) that take fewer comparisons by the bands of ``linked`` (node, n), n being the size of each band key a node has."""
    whole = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_DOCS)
    bands = linked.groupBy("node").agg(F.sum("n").alias("met")).join(members.select("component", "node"), "node").groupBy("component").agg(F.sum("met").alias("met"))
    return whole.join(bands, "component").filter(F.col("n").cast("double") * F.col("n") > BAND_COST * F.col("met")).select("component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its class and links.

    Columns: the id, copy_id (least id of the equal texts), class_id (least
    copy_id of the class), n_copies (rows with this text), n_text_links
    (different texts with a likeness of 0.8 or more), n_links (rows with these
    or this text, without the row itself), is_first (whether the row's text is
    the first of its class) and text_md5.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    # Texts go by their least id if that is a whole number, else, and without any, by a hash, below all ids.
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    number = F.col("id").cast("long") if whole else F.lit(None).cast("long")
    rows = docs.select(col(id_col).alias("id"), F.md5(text).alias("same"), text.alias("text"))
    own = F.coalesce(number, -F.abs(F.xxhash64("same")))
    keys = materialize(rows.select("id", "same"))
    copies = keys.groupBy("same").agg(F.coalesce(F.min(number), -F.abs(F.xxhash64("same"))).alias("node"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    reps = materialize(copies)
    # The sketches: of one row for each text, the first of those with the least id.
    sketch = rows.select(F.lit(0).cast("long").alias("id"), "same", "text").mapInArrow(_sketch, "id long, same string, n_grams long, sig binary").filter("sig is not null")
    nodes = materialize(sketch.dropDuplicates(["same"]).drop("id").join(reps.drop("first"), "same"))
    bands = materialize(nodes.select("node", "sig").mapInArrow(_bands, "node long, band long, at int"))
    shared = bands.groupBy("band").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = materialize(bands.join(shared, "band"))
    edges = linked.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    groups = connected_components(edges)
    members = materialize(groups.join(nodes, "node").select("component", "node", "same", "copies", "n_grams", "sig"))
    chained = materialize(by_bands(members, linked))
    by_component = members.join(chained, "component", "left_anti").select(F.col("component").alias("group"), F.lit(WHOLE).alias("at"), "node", "same", "copies", "n_grams", "sig")
    by_band = linked.select("node", "band", "at").join(members.join(chained, "component", "left_semi"), "node").select(F.col("band").alias("group"), "at", "node", "same", "copies", "n_grams", "sig")
    dealt = by_component.union(by_band)
    size = dealt.groupBy("group", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
    size = size.select("group", "at", F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("grams") / BLOCK_GRAMS, F.lit(1))).cast("int").alias("cut"))
    # The few groups beyond one block, each in as many places as there are salts, so that no task gets all members of one.
    large = size.filter("cut > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("same"), F.lit(SALTS)).cast("int")).join(large, ["group", "at", "salt"], "left")
    dealt = dealt.withColumn("cut", F.coalesce("cut", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    # Block x meets every block y >= x as left side, and every y < x as right side.
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
    cells = cells.withColumn("side", (F.col("other") < F.col("block")).cast("int"))
    cells = cells.withColumn("side", F.when(F.col("other") == F.col("block"), F.lit(DIAGONAL)).otherwise(F.col("side")))
    cells = cells.withColumn("cell", F.xxhash64("group", "at", F.least("block", "other"), F.greatest("block", "other")))
    # Texts of candidates alone are read again, each from the row with the least id.
    texts = rows.select("same", own.alias("node"), "text").join(members.select("same", "node"), ["same", "node"], "left_semi").dropDuplicates(["same"]).drop("node")
    work = cells.join(texts, "same").select("cell", "side", "node", "copies", "sig", "text", "at")
    work = work.repartition("cell").sortWithinPartitions("cell", "side", "node")
    found = materialize(work.mapInArrow(_linked, "node long, links long, docs long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_text = reps.join(links, "node", "left").join(classes, "node", "left")
    class_node = F.coalesce("component", "node")
    counts = [F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")]
    is_first = own == F.col("class_id")
    if whole:
        per_text = per_text.select("same", F.col("node").alias("copy_id"), class_node.alias("class_id"), *counts)
    else:
        name = F.coalesce(F.col("first").cast("string"), F.concat(F.lit("md5:"), F.col("same")))
        per_text = per_text.select("same", class_node.alias("class"), name.alias("copy_id"), *counts)
        per_text = per_text.join(per_text.groupBy("class").agg(F.min("copy_id").alias("class_id")), "class").drop("class")
        is_first = (F.col("copy_id") == F.col("class_id")) & (F.coalesce(F.col("id").cast("string"), F.concat(F.lit("md5:"), F.col("same"))) == F.col("copy_id"))
    return keys.join(per_text, "same").select(F.col("id").alias(id_col), "copy_id", "class_id", "n_copies", "n_text_links", "n_links", is_first.alias("is_first"), F.col("same").alias("text_md5"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each class with the least id, with all columns of ``docs``."""
    same, first_id, first_md5 = fresh(docs.columns, "same", "first_id", "first_md5")
    first = near_duplicates(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text").filter("is_first").select(F.col("id").alias(first_id), F.col("text_md5").alias(first_md5))
    rows = docs.withColumn(same, F.md5(F.coalesce(col(text_col).cast("string"), F.lit(""))))
    kept = rows.join(first.distinct().hint("shuffle_hash"), col(id_col).eqNullSafe(F.col(first_id)) & (F.col(same) == F.col(first_md5)), "left_semi")
    # Repeated rows of one id and text: one of them.
    return kept.dropDuplicates([id_col, same]).drop(same)
