"""Vectorised word hashing for batches of whole texts.

A word's 64-bit hash is a polynomial in a table of byte values, read off one
running sum per chunk, so the cost is a few numpy passes over the bytes and no
Python work per word.  ``A-Z`` and ``a-z`` share table values, which is the
ASCII lower-casing that the operators ask for.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text hashed at once; a longer text makes a chunk of its own.
CHUNK = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C13  # 3 modulo 8, so it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_EXACT_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POSITION = mix(np.arange(1, 65, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_powers: list[np.ndarray] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        tables = []
        for base in (_MULTIPLIER, _INVERSE):
            table = np.full(size, base, U64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=U64))
        if size > 4 * CHUNK:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def byte_slices(*columns: pa.Array, most: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges ``[start, stop)`` in which the texts of the columns hold ``most`` bytes or so; a longer row is alone."""
    rows = len(columns[0])
    ends = np.zeros(rows, np.int64)
    for column in columns:
        sizes = pc.fill_null(pc.binary_length(column), 0)
        ends += np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to
    give_back()


def give_back() -> None:
    """Return memory that Arrow and the C library hold for later: a worker is reused, and its peak would stay."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def as_bytes(texts: list) -> list[bytes]:
    """UTF-8 bytes of texts; a null text is empty."""
    return [b"" if t is None else t.encode("utf-8", "replace") for t in texts]


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, and each text's offsets into them."""
    hashes, counts = [np.empty(0, U64)], [np.zeros(1, np.int64)]
    for part in _chunks(texts):
        data = np.frombuffer(b" " + b" ".join(part) + b" ", np.uint8)
        power, inverse = _power_tables(len(data))
        space = _SPACE[data]
        edge = np.diff(space.view(np.int8))
        starts = np.flatnonzero(edge == -1) + 1
        ends = np.flatnonzero(edge == 1)  # the last byte of each word
        total = _TABLE[data]
        total *= power[: len(data)]
        np.cumsum(total, out=total)
        hashes.append(mix((total[ends] - total[starts - 1]) * inverse[starts]))
        lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
        begin = np.concatenate(([1], 1 + np.cumsum(lengths)))
        counts.append(np.diff(np.searchsorted(starts, begin)))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``[start, end)``, letters' case included."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_EXACT_TABLE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text; a shorter text has its whole sequence as one."""
    sizes = np.diff(offsets)
    whole = max(0, len(words) - k + 1)
    sums = np.zeros(whole, U64)
    for j in range(k):
        sums += words[j : j + whole] * _POSITION[j]
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = offsets[:-1][doc] + (np.arange(out_offsets[-1]) - out_offsets[:-1][doc])
    short = (sizes < k)[doc]
    out = np.empty(len(at), U64)
    out[~short] = mix(sums[at[~short]])
    for n in range(1, k):
        own = short & (sizes[doc] == n)
        value = np.full(int(own.sum()), _POSITION[32 + n], U64)
        for j in range(n):
            value += words[at[own] + j] * _POSITION[j]
        out[own] = mix(value)
    return out, out_offsets


def sorted_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in order, and the offsets into them."""
    values = values.copy()
    bounds = offsets.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
