"""Vectorised hashing of words and k-grams over Arrow string buffers.

All hashes are 64-bit polynomial hashes modulo 2**64, taken from one running
sum per block and then mixed; they do not depend on the Python process, so
equal strings hash alike on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are handled at once; a longer document forms its own block.
BLOCK = 1 << 20

#: Bytes 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, BLOCK + 1), base, dtype=U64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=U64))
    if n <= 4 * BLOCK:
        _powers["up"], _powers["down"] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that high and low bits are all usable."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U64((salt * 0xD1B54A32D192ED03) & _MASK))


def running(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; entry i covers the first i values."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up, out=out[1:], dtype=U64)
    return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have at most ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows i..j-1, and where each row's words begin.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  ``fold``
    lower-cases A-Z first.  The second array has j-i+1 entries.
    """
    seg = data[offsets[i] : offsets[j]]
    edges = (offsets[i : j + 1] - offsets[i]).astype(np.int64)
    n = len(seg)
    if n == 0:
        return np.zeros(0, U64), np.zeros(j - i + 1, np.int64)
    solid = ~SPACE[seg]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[edges[edges < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edges[edges > 0] - 1] = False
    s = np.flatnonzero(solid & ~before)
    e = np.flatnonzero(solid & ~after) + 1
    up, down = powers(n + 1)
    p = running((LOWER[seg] if fold else seg).astype(U64) + U64(1), up[:n])
    h = mix((p[e] - p[s]) * down[s] + (e - s).astype(U64))
    return h, np.searchsorted(s, edges)


#: Multipliers that join neighbouring word hashes; odd, fixed.
_JOIN = [U64((0xA24BAED4963EE407 * (2 * t + 1) ** 5) & _MASK | 1) for t in range(16)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring entries (none if fewer than k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    x = h[:n] * _JOIN[0]
    for t in range(1, k):
        x = x + h[t : t + n] * _JOIN[t]
    return mix(x)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Shingle hashes of one text's words; a shorter text is one shingle."""
    return grams(h, k) if len(h) >= k else grams(h, len(h)) if len(h) else h
