"""Packing token sequences of at most ``SIZE`` tokens by dynamic programming.

The tokens of the documents of a scan partition, in their order, form one
stream.  The stream is cut into sequences; allowed cuts are document ends,
sentence ends and, inside a sentence longer than ``STRIDE`` tokens, every
``STRIDE``-th token.  The cuts chosen minimise padding plus truncation
penalties (``SENTENCE_CUT`` for a cut between two sentences of a document,
``MIDDLE_CUT`` inside a sentence, none at a document's end).

With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + min over i of f(i) + padding(j - i),

where padding is SIZE minus the length, or 0 at a power of two.  The first kind
of padding makes f(i) + i the only thing that matters about i, so the minimum
over the last SIZE positions comes from a monotone queue in constant time; the
powers of two are a few further transitions.

The stream is worked off in blocks of about ``BLOCK`` tokens; tokens after the
last cut of a block open the next one, so memory stays bounded however long a
document or a partition is.  No rows are shuffled.

Token ids are those of the ``tokenizers`` library.  Texts are split into the
vocabulary's pre-tokens with numpy, each distinct pre-token is looked up or
encoded once, and the ids are put in place by index.  Texts that hold an
apostrophe (contractions have rules of their own) or a code point above 0xFFFF
are encoded by ``tiktoken``, which has the same vocabulary, and texts that
spell a special token by ``tokenizers`` itself.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed each; the order of documents is that of the scan.
"""

from __future__ import annotations

import base64
import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm.arrays import U64, mix, powers, running

SIZE = 1024
END = 0
STRIDE = 128
SENTENCE_CUT = 2
MIDDLE_CUT = 24
BLOCK = 1 << 19
#: Distinct pre-tokens kept between batches by one Python worker.
KNOWN = 400_000

_LETTER, _NUMBER, _WHITE, _OTHER = range(4)


def _classes() -> np.ndarray:
    """Class of each code point up to 0xFFFF, as the vocabulary's pattern has it."""
    kinds = np.full(0x10000, _OTHER, dtype=np.uint8)
    for c in range(0x10000):
        first = unicodedata.category(chr(c))[0]
        if first in "LN":
            kinds[c] = _LETTER if first == "L" else _NUMBER
    kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _WHITE
    return kinds


class Tokens:
    """Token ids of many texts at once."""

    def __init__(self, folder: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.folder = folder
        self.encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.encoding.encode_single_token, self.encoding._core_bpe.encode_single_piece
        self.kinds = _classes()
        self.full = None
        ends = np.zeros(len(ranks) + 1, dtype=bool)
        for token, rank in ranks.items():
            ends[rank] = token.rstrip(b"\"')")[-1:] in (b".", b"!", b"?") or b"\n" in token
        #: Whether a sentence may end after a token.
        self.ends = ends
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.count, self.pool = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def exactly(self, text: str) -> np.ndarray:
        """By the tokenizers library itself."""
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(os.path.join(self.folder, "byte_bpe_50k.json"))
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _split(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin."""
        n = len(points)
        kind = self.kinds[points]
        opens = np.zeros(n + 1, bool)
        opens[edges] = True
        opens = opens[:n]
        start = opens.copy()
        start[1:] |= kind[1:] != kind[:-1]
        white = kind == _WHITE
        # The last white space before a token parts from its run; a plain space joins the token.
        last = np.zeros(n, bool)
        last[:-1] = white[:-1] & ~white[1:] & ~opens[1:]
        start |= last
        joins = last & (points == 0x20)
        start[1:] &= ~joins[:-1]
        return np.flatnonzero(start)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end token."""
        plain = [i for i, t in enumerate(texts) if t and "'" not in t and "<|endoftext|>" not in t and len(t.encode("utf-16-le", "surrogatepass")) == 2 * len(t)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in {*range(len(texts))} - {*plain}:
            if texts[i]:
                out[i] = self.exactly(texts[i]) if "<|endoftext|>" in texts[i] else np.array(self.encoding.encode_ordinary(texts[i]), dtype=np.uint32)
        at = 0
        while at < len(plain):
            to, size = at, 0
            while to < len(plain) and (to == at or size + len(texts[plain[to]]) <= 1 << 20):
                size += len(texts[plain[to]])
                to += 1
            for i, ids in zip(plain[at:to], self._block([texts[i] for i in plain[at:to]]), strict=True):
                out[i] = ids
            at = to
        return out

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        s = self._split(points, edges[:-1])
        e = np.append(s[1:], len(points))
        up, down = powers(len(points) + 1)
        p = running(points.astype(U64) + U64(1), up[: len(points)])
        h = mix((p[e] - p[s]) * down[s] + (e - s).astype(U64))
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        place = self._places(distinct, first, s, e, whole)
        begin, count = self.begin[place][which], self.count[place][which]
        ends = np.cumsum(count)
        ids = self.pool[np.arange(ends[-1]) - np.repeat(ends - count - begin, count)]
        parts = np.concatenate(([0], ends))[np.searchsorted(s, edges)]
        return [ids[parts[k] : parts[k + 1]] for k in range(len(texts))]

    def _places(self, distinct: np.ndarray, first: np.ndarray, s: np.ndarray, e: np.ndarray, whole: str) -> np.ndarray:
        """Where in the table of known pre-tokens the distinct ones are; new ones are added."""
        if len(self.keys) > KNOWN:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        missing = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        missing[inside] = self.keys[at[inside]] != distinct[inside]
        if missing.any():
            encode = self.piece[1]
            new = [encode(whole[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(s[first[missing]].tolist(), e[first[missing]].tolist(), strict=True)]
            count = np.array([len(x) for x in new], dtype=np.int64)
            keys = np.concatenate((self.keys, distinct[missing]))
            begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(count) - count))
            order = np.argsort(keys, kind="stable")
            self.pool = np.concatenate((self.pool, np.array([t for x in new for t in x], dtype=np.uint32)))
            self.keys, self.begin, self.count = keys[order], begin[order], np.concatenate((self.count, count))[order]
            at = np.searchsorted(self.keys, distinct)
        return at


def padding(length: int, size: int = SIZE) -> int:
    """Tokens that fill a sequence up."""
    return 0 if length & (length - 1) == 0 else size - length


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int = SIZE, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, and the penalty of each."""
    n = len(ids)
    after = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    at = np.union1d(after, doc_ends)
    gap = np.diff(np.concatenate(([0], at, [n])))
    far = np.flatnonzero(gap > stride)
    base = np.concatenate(([0], at))
    more = [np.arange(base[k] + stride, base[k] + gap[k], stride) for k in far]
    middle = np.concatenate(more) if more else np.zeros(0, np.int64)
    points = np.union1d(np.union1d(at, middle), [n])
    cost = np.full(len(points), float(SENTENCE_CUT))
    cost[np.isin(points, middle)] = MIDDLE_CUT
    cost[np.isin(points, doc_ends)] = 0
    return points[points > 0].astype(np.int64), cost[points > 0]


def best_cuts(points: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """The cheapest cuts of a stream that ends at the last of ``points``.

    No two neighbouring points, nor 0 and the first, are more than ``size``
    apart.  The last point is always a cut.
    """
    pos = [0, *points.tolist()]
    pen = [0.0, *cost.tolist()]
    n = len(pos)
    table = np.full(pos[-1] + 1, -1, dtype=np.int64)
    table[pos] = np.arange(n)
    extra: dict[int, list[int]] = {}
    step = 1
    while step <= size:
        ok = np.flatnonzero(points >= step)
        src = table[points[ok] - step]
        for j, i in zip((ok[src >= 0] + 1).tolist(), src[src >= 0].tolist(), strict=True):
            extra.setdefault(j, []).append(i)
        step *= 2
    f = [0.0] * n
    back = [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        p = pos[j]
        low = p - size
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best = value + size - p
        for k in extra.get(j, ()):
            if f[k] <= best:
                best, i = f[k], k
        best += pen[j]
        f[j] = best
        back[j] = i
        g = best + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def pack(docs: DataFrame, tokenizer_folder: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and ids.  ``sequence_id`` is unique over the table, ``offset`` gapless from
    0 within a sequence.  Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokens(tokenizer_folder)
        sequence = (TaskContext.get().partitionId()) << 33
        held: list[list] = []  # id, ids, start within the document, tokens of the document

        def flush(last: bool, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            if not held:
                return
            stream = np.concatenate([h[1] for h in held])
            doc_ends = np.cumsum([len(h[1]) for h in held])
            cuts = best_cuts(*cut_points(stream, doc_ends, encode.ends, size, min(STRIDE, size)), size)
            if not last and len(cuts) > 1:
                cuts = cuts[:-1]
            rows, d, at = [], 0, 0
            base = 0
            for cut in cuts:
                begin = at
                while at < cut:
                    key, ids, start, total = held[d]
                    stop = min(cut, base + len(ids))
                    part = ids[at - base : stop - base]
                    rows.append((key, start + at - base, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, sequence, at - begin, part))
                    at = stop
                    if stop == base + len(ids):
                        base = stop
                        d += 1
                sequence += 1
            rest = held[d:]
            if rest and at > base:
                key, ids, start, total = rest[0]
                rest[0] = [key, ids[at - base :], start + at - base, total]
            held = rest
            cols = list(zip(*rows, strict=True))
            lengths = np.concatenate(([0], np.cumsum(cols[2]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(cols[7]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), ids], names=names)

        waiting, key_type = 0, pa.int64()
        for b in batches:
            key_type = b.schema.field(0).type
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                for key, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(END))
                    held.append([key, ids, 0, len(ids)])
                    waiting += len(ids)
                    if waiting >= BLOCK:
                        yield from flush(False, key_type)
                        waiting = sum(len(h[1]) for h in held)
        yield from flush(True, key_type)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
