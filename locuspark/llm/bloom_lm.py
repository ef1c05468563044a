"""Scoring texts by a log-frequency Bloom filter language model.

Texts are taken in stretches of ``STRETCH`` tokens, a row each of a table of
token numbers.  The distinct words, word pairs and, at ``ORDER`` 3, word triples
of each stretch go to the shards of their hashes, with their counts.  A shard
sums the counts and writes its share of the filter.  Counts are quantised to the
levels 1, 2, ..., 8-9, 10-11, ..., 16-19, ... (four an octave); the filter holds
the keys (n-gram, 1) ... (n-gram, level), so a level is found by probing 1, 2,
... until a probe fails.  A false positive raises a level by one at most with
the filter's error rate (0.4 %), by two with its square, and so on.

All probabilities come from probes of that one filter:

* words: m(level) is the mean count of the words of a level in the corpus, so
  that the m of all words sum to the number of tokens; absolute discounting, and
  all unseen words are one type that shares the discounted mass,
* pairs: (low(pair) + PRIOR * word probability) / (high(first word) + PRIOR),
* triples: (low(triple) + PRIOR * pair probability) / (high(first pair) + PRIOR),

where low and high are the least and the largest count of a level.  As low is at
most, and high at least, the true count, the probabilities of all next tokens
sum to one at most, but for false positives.  An n-gram is probed only if the
words, and the pairs, that it is made of are found.  The model's probability of
a text is the mean, weighted by ``SHARES``, of these chains over its tokens,
which is a distribution over texts as the chains are.

No n-gram is left out, however many there are.  The filter of a corpus of up to
``SMALL`` bytes of token numbers is broadcast to the workers, in parts of about
``PART_BYTES`` and ``HEAD`` words at most (those of one shard at least), of which
a task has one in memory at a time.  As every task reads all of a broadcast, and
both it and the texts grow with the corpus, that would be quadratic; so beyond
that size no task has the whole filter: the n-grams of the stretches to score are
probed in the tasks of their shards, and the levels go back to the stretches, a
byte each, words with their exact counts for the base figures (the score does
not use these).  So each n-gram of a stretch is sent and probed once, whatever
the size of the model, and all work and traffic is in proportion to the corpus.
Both ways ask the same filter and give the same figures.  A shard has the n-grams
of two stretches at most, on the average.  The shards together have about 12 bits
for each level of each different n-gram of the corpus, and 10 to 16 bytes for
each different word.

Defined cases: a null or empty text is the end token alone; a null id counts as
the empty string in the split; repeated rows are trained on and scored each; an
empty table gives no row; texts of any length are taken whole, also where that
makes a stretch longer; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.llm.arrays import _JOIN, BLOCK, U64, blocks, buffers, mix, salted, words
from locuspark.plans.naming import col
from locuspark.plans.scratch import materialize

BITS = 12
PROBES = 6
#: Bits of any shard's filter at least, so that small models have next to no false positives.
LEAST_BITS = 1 << 16
PART_BYTES = 24 << 20
HEAD = 1_000_000
PRIOR = 4.0
#: Longest n-grams of the model, 2 or 3, and the weights of its chains.
ORDER = 2
SHARES = {2: (0.9, 0.1), 3: (0.9, 0.05, 0.05)}
#: Bytes of token numbers up to which the filter is broadcast (it has at most 3 bytes a token, 4.5 at order 3, and 16 a different word).
SMALL = 16 << 20
#: Tokens of a stretch, but for what its last block of texts has beyond.
STRETCH = 1_000_000

END = U64(0x5DEECE66D1234567)
START = U64(0x2545F4914F6CDD1D)

#: Least count of each level, from level 1 on; level 0 is no count.
_LEVELS = 160
_LEAST = np.array([0, 1, 2, 3, *(x << i for i in range(40) for x in (4, 5, 6, 7))][: _LEVELS + 1], dtype=np.int64)
_MOST = np.append(_LEAST[1:] - 1, np.iinfo(np.int64).max // 2)


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id, as text, mod 7 is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with ends, the hash before each one, and where rows begin."""
    h, edge = words(data, at, i, j, fold=True)
    now = np.insert(h, edge[1:], END)
    begin = edge + np.arange(j - i + 1)
    return now, preceding(now, begin), begin


def preceding(now: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The hash before each token, from the tokens and where rows begin."""
    before = np.empty(len(now), U64)
    before[1:] = now[:-1]
    before[begin[:-1]] = START
    return before


#: Keys of pairs and triples have 56 bits, so that they take less room on their way to the shards.
_KEPT = U64((1 << 64) - 256)


def pair(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(before * _JOIN[0] + now * _JOIN[1]) & _KEPT


def triples(now: np.ndarray, before: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token with the two before it (the second may be the start), and the tokens that have them."""
    has = np.ones(len(now), bool)
    has[begin[:-1]] = False
    at = np.flatnonzero(has)
    return mix(before[at - 1] * _JOIN[2] + before[at] * _JOIN[3] + now[at] * _JOIN[4]) & _KEPT, at


def level(counts: np.ndarray) -> np.ndarray:
    """The level of each count of 1 or more."""
    return np.searchsorted(_LEAST, counts, side="right") - 1


def bit_places(keys: np.ndarray, at_level: int, bits: int) -> Iterator[np.ndarray]:
    """Bit positions of a level's keys, one array for each probe."""
    a = salted(keys, at_level)
    b = salted(a, 3) | U64(1)
    for t in range(PROBES):
        yield (a + U64(t) * b) % U64(bits)


def filled(keys: np.ndarray, counts: np.ndarray, most_bytes: int | None = None) -> np.ndarray:
    """A filter of the keys at all levels up to their own, packed into bytes.

    It has ``BITS`` bits for each of these, or fewer if ``most_bytes`` says so.
    """
    lev = level(counts)
    size = max(LEAST_BITS, -(-int(lev.sum()) * BITS // 64) * 64)
    if most_bytes is not None:
        size = max(64, min(size, most_bytes // 8 * 64))
    bits = np.zeros(size, dtype=bool)
    for x in range(1, int(lev.max(initial=0)) + 1):
        for place in bit_places(keys[lev >= x], x, size):
            bits[place] = True
    return np.packbits(bits)


def shard_of(keys: np.ndarray, shift: int) -> np.ndarray:
    return np.zeros(len(keys), np.int64) if shift == 64 else (keys >> U64(shift)).astype(np.int64)


class Filter:
    """Shards of a log-frequency filter, of ``total`` in all; a key's shard is in its top bits."""

    def __init__(self, filters: list[bytes], shards: np.ndarray | None = None, total: int | None = None):
        total = total or len(filters)
        self.shift = 64 - (total.bit_length() - 1)
        #: Place here of each shard.
        self.place = np.zeros(total, np.int64)
        self.place[np.arange(total) if shards is None else shards] = np.arange(len(filters))
        sizes = np.array([len(s) for s in filters], dtype=np.int64)
        self.bits = (sizes * 8).astype(U64)
        self.begin = ((np.cumsum(sizes) - sizes) * 8).astype(U64)
        self.bytes = np.frombuffer(b"".join(filters), dtype=np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by probing one level after the other."""
        out = np.zeros(len(keys), dtype=np.uint8)
        open_ = np.arange(len(keys))
        shard = self.place[shard_of(keys, self.shift)]
        at = 1
        while len(open_):
            k, s = keys[open_], shard[open_]
            a = salted(k, at)
            b = salted(a, 3) | U64(1)
            for t in range(PROBES):
                place = (a + U64(t) * b) % self.bits[s] + self.begin[s]
                hit = (self.bytes[(place >> U64(3)).astype(np.int64)] >> (U64(7) - (place & U64(7))).astype(np.uint8)) & 1 == 1
                open_, a, b, s = open_[hit], a[hit], b[hit], s[hit]
                if not len(open_):
                    break
            out[open_] = at
            at += 1
        return out


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest one needs; the first byte says how many."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def wide(b: bytes) -> np.ndarray:
    """What ``narrow`` was given."""
    parts = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(parts), 8), np.uint8)
    out[:, : b[0]] = parts
    return out.view("<u8").ravel().astype(U64)


_ROWS = "stretch long, ids array<{}>, words binary, tokens binary, lengths binary, learned binary"
_PART = "stretch long, kind int, shard int, keys binary, counts binary, filter binary"
_PART_ARROW = pa.schema([("stretch", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary())])


def _shift(kind: int) -> U64:
    return U64(8 if kind > 1 else 0)


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[tuple]:
    """Rows of sorted keys by shard, as steps from one to the next; a byte for each count, then those from 255 on (nothing if all are 1)."""
    edge = np.append(np.searchsorted(keys, np.array([(s << 64) // shards for s in range(shards)], dtype=U64)), len(keys))
    for s in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        own = (keys[edge[s] : edge[s + 1]] - U64((s << 64) // shards)) >> _shift(kind)
        c = counts[edge[s] : edge[s + 1]]
        yield kind, s, narrow(np.diff(own, prepend=U64(0))), b"" if (c == 1).all() else np.minimum(c, 255).astype(np.uint8).tobytes() + narrow(c[c >= 255])


def _unpacked(kind: int, shard: int, keys: bytes, counts: bytes, shards: int) -> tuple[np.ndarray, np.ndarray]:
    k = (np.cumsum(wide(keys), dtype=U64) << _shift(kind)) + U64((shard << 64) // shards)
    if not counts:
        return k, np.ones(len(k), np.int64)
    c = np.frombuffer(counts, np.uint8, len(k)).astype(np.int64)
    c[c == 255] = wide(counts[len(k) :]).astype(np.int64)
    return k, c


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _taken(most: int):
    """Stretches of at least ``most`` tokens (the last one of a task has fewer): ids, distinct words, the number of each token's word, tokens of each text and whether it is learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["stretch", "ids", "words", "tokens", "lengths", "learned"]
        n = done = 0

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            key, which = np.unique(np.concatenate([x[1] for x in held]), return_inverse=True)
            flat = [narrow(np.diff(key, prepend=U64(0))), narrow(which), narrow(np.concatenate([x[2] for x in held])), np.concatenate([x[3] for x in held]).tobytes()]
            held.clear()
            number = (TaskContext.get().partitionId() << 32) + done
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in flat)], names=names)

        for b in batches:
            data, at = buffers(b.column(1))
            learned = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for i, j in blocks(at, min(BLOCK, most)):
                now, _, begin = tokens(data, at, i, j)
                held.append((b.column(0).slice(i, j - i), now, np.diff(begin), learned[i:j]))
                n += len(now)
                if n >= most:
                    yield out()
                    n, done = 0, done + 1
        if held:
            yield out()

    return run


def _tokens_of(words: bytes, numbers: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``tokens`` gave for the texts of a stretch."""
    now = np.cumsum(wide(words), dtype=U64)[wide(numbers).astype(np.int64)]
    begin = np.append(0, np.cumsum(wide(lengths).astype(np.int64)))
    return now, preceding(now, begin), begin


def _counted(shards: int, order: int):
    """Words (kind 1), pairs (kind 2) and triples (kind 3) of each stretch by shard, with their counts in the texts that are learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stretch, *row, flags in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now, before, begin = _tokens_of(*row)
                learned = np.repeat(np.frombuffer(flags, np.uint8), np.diff(begin))
                asked = [(now, learned), (pair(before, now), learned)]
                if order > 2:
                    key, at = triples(now, before, begin)
                    asked.append((key, learned[at]))
                for kind, (keys, some) in enumerate(asked, 1):
                    rows = [(stretch, *x, None) for x in _packed(kind, *_summed(keys, some)[:2], shards)]
                    if rows:
                        yield _batch(rows, _PART_ARROW)

    return run


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts, and the place of each key."""
    out, which = np.unique(keys, return_inverse=True)
    return out, np.bincount(which, counts, len(out)).astype(np.int64), which


_MODEL = "shard int, words binary, counts binary, filter binary, stats array<bigint>, stretch long, kind int, levels binary, exact binary"
_MODEL_ARROW = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary()), ("stats", pa.list_(pa.int64())), ("stretch", pa.int64()), ("kind", pa.int32()), ("levels", pa.binary()), ("exact", pa.binary())])


def _joined(shards: int, answer: bool):
    """Exact word counts, the filter and figures of the one shard of a partition, unless it comes ready (kind 0); with ``answer`` the levels of all keys of the stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {1: []}
        ready = shard = None
        for b in batches:
            for stretch, kind, shard, keys, counts, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: B007
                if kind:
                    held.setdefault(kind, []).append((stretch, *_unpacked(kind, shard, keys, counts, shards)))
                else:
                    ready = (shard, keys, counts, bits)
        if shard is None:
            return
        summed = {kind: _summed(*(np.concatenate([np.zeros(0, t), *(x[i] for x in rows)]) for i, t in ((1, U64), (2, np.int64)))) for kind, rows in sorted(held.items())}
        if ready is None:
            known = [(k[c > 0], c[c > 0]) for k, c, _ in summed.values()]
            k, c = known[0]
            lev = level(c)
            end = int(c[k == END].sum())
            stats = [len(k), int(c.sum()), int((c == 1).sum()), int((c == 2).sum()), end, *np.bincount(lev, minlength=_LEVELS + 1).tolist(), *(int(x) for x in np.bincount(lev, c, minlength=_LEVELS + 1))]
            ready = (shard, k.tobytes(), narrow(c), filled(*(np.concatenate(x) for x in zip(*known, strict=True))).tobytes())
            yield _batch([(*ready, stats, None, None, None, None)], _MODEL_ARROW)
        if not answer:
            return
        part = Part([ready], shards)
        for kind, (k, _, which) in summed.items():
            lev, n = part.filter.levels(k), part.exact(k) if kind == 1 else None
            end = np.cumsum([len(x[1]) for x in held[kind]])
            for (stretch, own, _), e in zip(held[kind], end, strict=True):
                at = which[e - len(own) : e]
                yield _batch([(shard, None, None, None, None, stretch, kind, lev[at].tobytes(), None if n is None else narrow(n[at]))], _MODEL_ARROW)

    return run


class Model:
    """What scoring needs beside the parts: figures of the corpus and of the levels."""

    def __init__(self, stats: np.ndarray):
        self.types, self.total, n1, n2, self.docs = (int(x) for x in stats[:5])
        self.discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        number, sums = stats[5:].reshape(2, -1)
        #: Mean count of the words of each level; of levels without words, which false positives reach, the least.
        self.mean = np.where(number > 0, sums / np.maximum(number, 1), _LEAST)
        self.shards, self.order = 1, ORDER
        self.table: DataFrame | None = None
        self.head, self.part_bytes = HEAD, PART_BYTES
        self._parts: list[Broadcast] | None = None

    def __getstate__(self) -> dict:
        """The figures alone go to the workers."""
        return vars(self) | {"table": None, "_parts": None}

    @property
    def parts(self) -> list[Broadcast]:
        """The shards in broadcasts; one is closed before it would have more than ``part_bytes`` or ``head`` words."""
        if self._parts is None:
            self._parts, rows = [], []

            def close() -> None:
                if rows:
                    self._parts.append(self.table.sparkSession.sparkContext.broadcast(Part(rows, self.shards)))
                    rows.clear()

            # The driver gets one part at a time.
            for r in self.table.select("shard", "words", "counts", "filter").toLocalIterator():
                row = (r[0], bytes(r[1]), bytes(r[2]), bytes(r[3]))
                if sum(len(x) for o in [*rows, row] for x in o[1:]) > self.part_bytes or sum(len(o[1]) // 8 for o in [*rows, row]) > self.head:
                    close()
                rows.append(row)
            close()
        return self._parts

    def word(self, levels: np.ndarray) -> np.ndarray:
        """Discounted probability of words of these levels; all unseen words are one type."""
        if not self.total:
            return np.ones(len(levels))
        return np.where(levels > 0, self.mean[levels] - self.discount, self.discount * self.types) / self.total

    def chains(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """Probabilities of each token by words, by pairs and, at order 3, by triples, from the levels of its n-grams."""
        inner = np.ones(len(one), bool)
        inner[begin[:-1]] = False
        at = np.flatnonzero(inner)
        first = np.full(len(one), self.docs, np.int64)
        first[at] = _MOST[one[at - 1]]
        p1 = self.word(one)
        p2 = (_LEAST[two] + PRIOR * p1) / (first + PRIOR)
        if self.order < 3:
            return [p1, p2]
        p3 = p2.copy()
        p3[at] = (_LEAST[three[at]] + PRIOR * p2[at]) / (_MOST[two[at - 1]] + PRIOR)
        return [p1, p2, p3]


class Part:
    """Some shards of the filter, and the exact counts of their words."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]], total: int):
        rows = sorted(rows)
        self.shards = np.array([r[0] for r in rows], dtype=np.int64)
        self.keys = np.concatenate([np.frombuffer(r[1], U64) for r in rows])
        counts = np.concatenate([wide(r[2]) for r in rows])
        self.counts = counts.astype(np.min_scalar_type(int(counts.max(initial=1))))
        self.filter = Filter([r[3] for r in rows], self.shards, total)

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Exact counts of words."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at].astype(np.int64), 0)


def stretches(docs: DataFrame, learn: Column, id_col: str, text_col: str, most: int) -> DataFrame:
    """The tokens of all texts, a row for each stretch of about ``most``, written once."""
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return materialize(rows.mapInArrow(_taken(most), _ROWS.format(docs.schema[id_col].dataType.simpleString())))


def _sharded(texts: DataFrame, shards: int, order: int, answer: bool, table: DataFrame | None = None) -> DataFrame:
    """The table of the shards (those of ``table`` are ready), and what they say of the stretches."""
    rows = texts.select("stretch", "words", "tokens", "lengths", "learned").mapInArrow(_counted(shards, order), _PART)
    if table is not None:
        ready = [F.lit(None).cast("long"), F.lit(0), "shard", "words", "counts", "filter"]
        rows = rows.union(table.select(*ready))
    # Each shard, and nothing else, in a task of its own.
    return materialize(rows.repartitionById(shards, "shard").mapInArrow(_joined(shards, answer), _MODEL))


def _trained(texts: DataFrame, order: int, answer: bool) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the learned texts, the table of its shards, and what these say of all stretches."""
    shards = 1 << max(0, ((texts.count() + 1) // 2 - 1).bit_length())
    out = _sharded(texts, shards, order, answer)
    # The driver gets one row of figures for each shard.
    table = out.filter("stretch is null")
    stats = np.zeros(5 + 2 * (_LEVELS + 1), np.int64)
    for r in table.select("stats").toLocalIterator():
        stats += np.array(r[0], dtype=np.int64)
    model = Model(stats)
    model.shards, model.order, model.table = shards, order, table
    return model, table, out


def train(docs: DataFrame, text_col: str = "text", head: int = HEAD, part_bytes: int = PART_BYTES, order: int = ORDER, stretch: int = STRETCH) -> tuple[Model, DataFrame]:
    """The model of all texts, of n-grams up to ``order``, and the table of its shards."""
    rows = docs.select(F.lit(0).alias("id"), col(text_col).alias("text"))
    model, table, _ = _trained(stretches(rows, F.lit(True), "id", "text", stretch), order, False)
    model.head, model.part_bytes = head, part_bytes
    return model, table


class Probes:
    """What the parts know of keys; one part is in memory at a time."""

    def __init__(self, parts: list[Broadcast], shards: int):
        self.parts, self.shards = parts, shards

    def levels(self, *asked: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The levels of several arrays of keys, and exact counts of the first, which are words."""
        distinct = [np.unique(k, return_inverse=True) for k in asked]
        found = [np.zeros(len(k), np.uint8) for k, _ in distinct]
        exact = np.zeros(len(distinct[0][0]), np.int64)
        shard = [shard_of(k, 64 - (self.shards.bit_length() - 1)) for k, _ in distinct]
        for shared in self.parts:
            part, mine = shared.value, np.zeros(self.shards, bool)
            mine[part.shards] = True
            for i, (k, _) in enumerate(distinct):
                at = np.flatnonzero(mine[shard[i]])
                found[i][at] = part.filter.levels(k[at])
                if i == 0:
                    exact[at] = part.exact(k[at])
            del part
            if len(self.parts) > 1:
                # Only the value kept by the worker goes; the broadcast stays on the executor's disk.
                vars(shared).pop("_value", None)
        return [out[which] for (_, which), out in zip(distinct, found, strict=True)], exact[distinct[0][1]]


class Answers:
    """What the shards said of the keys of one stretch; asked as ``Probes`` is."""

    def __init__(self, said: pa.Table):
        self.said: dict[int, list[tuple]] = {}
        for kind, *row in sorted(zip(*(said.column(c).to_pylist() for c in ("kind", "shard", "levels", "exact")), strict=True)):
            self.said.setdefault(kind, []).append(row)

    def levels(self, *asked: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        out, exact = [], np.zeros(0, np.int64)
        for kind, keys in enumerate(asked, 1):
            k, which = np.unique(keys, return_inverse=True)
            rows = self.said.get(kind, [])
            found = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
            if len(found) != len(k):
                raise ValueError(f"{len(found)} answers for {len(k)} n-grams")
            out.append(found[which])
            if kind == 1:
                exact = np.concatenate([np.zeros(0, U64), *(wide(r[2]) for r in rows)]).astype(np.int64)[which]
        return out, exact


def levels_of(probes: Probes | Answers, now: np.ndarray, before: np.ndarray, begin: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels of the word, the pair and the triple that end at each token, 0 if what they are made of is not found; the word's exact count."""
    key, at = triples(now, before, begin)
    (one, two, *longer), exact = probes.levels(now, pair(before, now), *([key] if order > 2 else []))
    first = np.ones(len(now), bool)
    first[at] = one[at - 1] > 0
    two = np.where((one > 0) & first, two, 0)
    three = np.zeros(len(now), np.uint8)
    for some in longer:
        three[at] = np.where((two[at] > 0) & (two[at - 1] > 0), some, 0)
    return one, two, three, exact


def _log_mean(chains: list[np.ndarray]) -> np.ndarray:
    """log10 of the weighted mean of 10**x over the chains."""
    x = np.stack(chains)
    top = x.max(axis=0)
    return top + np.log10(np.array(SHARES[len(chains)]) @ np.power(10.0, x - top))


_SCORES = "id {}, n_tokens long, n_known long, base_score double, score double"


def _row_scores(ids: pa.Array, row: tuple[bytes, bytes, bytes], probes: Probes | Answers, model: Model) -> list[pa.Array]:
    """The columns of ``_SCORES`` for the texts of one stretch."""
    now, before, begin = _tokens_of(*row)
    *levels, known = levels_of(probes, now, before, begin, model.order)
    sums = [np.add.reduceat(np.log10(p), begin[:-1]) for p in model.chains(*levels, begin)]
    base = np.log10((known + 1) / (model.total + model.types + 1))
    flat = [np.diff(begin), np.add.reduceat((known > 0).astype(np.int64), begin[:-1]), np.add.reduceat(base, begin[:-1]), _log_mean(sums)]
    return [ids, *map(pa.array, flat)]


_NAMES = ["id", "n_tokens", "n_known", "base_score", "score"]


def _scored(texts: DataFrame, said: DataFrame, model: Model, id_col: str) -> DataFrame:
    """Row for row of the stretches: the id, n_tokens, n_known, base_score and score, from what the shards said."""

    def run(texts: pa.Table, said: pa.Table) -> pa.Table:
        row = tuple(texts.column(c)[0].as_py() for c in ("words", "tokens", "lengths"))
        return pa.Table.from_arrays(_row_scores(texts.column("ids").combine_chunks().flatten(), row, Answers(said), model), names=_NAMES)

    kind = texts.schema["ids"].dataType.elementType.simpleString()
    asked = texts.select("stretch", "ids", "words", "tokens", "lengths").repartition(2 * model.shards, "stretch").groupBy("stretch")
    answers = said.filter("stretch is not null").select("stretch", "kind", "shard", "levels", "exact").repartition(2 * model.shards, "stretch").groupBy("stretch")
    return asked.cogroup(answers).applyInArrow(run, _SCORES.format(kind)).withColumnRenamed("id", id_col)


def _probed(texts: DataFrame, model: Model, id_col: str) -> DataFrame:
    """What ``_scored`` gives, from the broadcast filter."""
    probes = Probes(model.parts, model.shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                yield pa.RecordBatch.from_arrays(_row_scores(b.column(0).slice(i, 1).flatten(), row, probes, model), names=_NAMES)

    kind = texts.schema["ids"].dataType.elementType.simpleString()
    return texts.select("ids", "words", "tokens", "lengths").mapInArrow(run, _SCORES.format(kind)).withColumnRenamed("id", id_col)


def score(docs: DataFrame, model: Model, table: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """Row for row: the id, n_tokens, n_known, base_score and score; ``table`` is that of the model's shards."""
    texts = stretches(docs, F.lit(False), id_col, text_col, stretch)
    return _scored(texts, _sharded(texts, model.shards, model.order, True, model.table if table is None else table), model, id_col)


def train_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, stretch: int = STRETCH, small: int = SMALL) -> tuple[Model, DataFrame]:
    """The model of the texts that ``learn`` holds for, and what ``score`` gives for all texts.

    The filter is broadcast if the token numbers take ``small`` bytes at most;
    else it stays in its shards, and n-grams are sent there once for both.  The
    results are the same.
    """
    texts = stretches(docs, learn, id_col, text_col, stretch)
    # A token's number takes a byte at least, so this bounds the tokens, and with them the filter.
    size = texts.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0))).first()[0]
    model, _, said = _trained(texts, order, size > small)
    return model, _scored(texts, said, model, id_col) if size > small else _probed(texts, model, id_col)
