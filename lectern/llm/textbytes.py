"""Vectorised views of many texts at once: word bounds, word and window fingerprints, minimizers.

Every function takes one flat byte array of several documents plus their offsets, so that the cost for each
document is a handful of numpy passes rather than a Python loop over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents are taken together until they hold this many bytes; a longer document goes alone, whole.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_R = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n; kept while n is of an ordinary chunk's size."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        r = int(_R[which])
        out = []
        for base in (r, pow(r, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 4 * CHUNK_BYTES:
            _POWERS[which] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and its offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole documents."""
    data, offsets = flat(col)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document where its words begin in them (one more at the end)."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ns = ~_SPACE[b]
    before = np.empty(len(b), bool)
    before[0], before[1:] = False, ns[:-1]
    before[off[:-1][off[:-1] < len(b)]] = False
    after = np.empty(len(b), bool)
    after[-1], after[:-1] = False, ns[1:]
    ends = off[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(ns & ~before)
    stops = np.flatnonzero(ns & ~after) + 1
    return starts, stops, np.searchsorted(starts, off)


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(which, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, s: np.ndarray, e: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprints of values[s:e] from their prefix sums: equal contents have equal fingerprints anywhere."""
    return mix((pre[e] - pre[s]) * powers(which, len(pre))[1][s] + (e - s).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_hashes(b: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
    v = (_LOWER[b] if lower else b).astype(np.uint64) + np.uint64(1)
    return spans_hash(prefix(v, which), starts, stops, which)


def doc_of(off: np.ndarray, n: int) -> np.ndarray:
    """The document of each of n flat positions."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off)) if n else np.zeros(0, np.int64)


def minimizers(h: np.ndarray, off: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `window` units that lies in one document: its start, and where its least k-gram begins.

    h has a fingerprint for the k-gram at each position (those that run over a document's end are never used).
    The choice depends on the window's content alone, the leftmost of equals, so equal windows choose alike.
    """
    n = len(h)
    width = window - k + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(20, int(n).bit_length()))
    m = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    if size < width:
        step = width - size
        m = np.minimum(m[: len(m) - step], m[step:])
    lasts = np.repeat(off[1:], np.diff(off))[: len(m)]
    valid = np.flatnonzero(np.arange(len(m)) + window <= lasts)
    return valid, (m[valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def kgram_hashes(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A fingerprint of values[i:i+k] for each i (shorter at the very end), from unsigned 64-bit values."""
    pre = prefix(values, which)
    i = np.arange(len(values))
    return spans_hash(pre, i, np.minimum(i + k, len(values)), which)
