"""Vectorised text kernels: byte classes, word bounds, rolling hashes, sliding minima.

All work on one chunk of documents at a time: their UTF-8 bytes laid end to end, with offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE1, BASE2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Bytes of text that a chunk holds, unless one document alone is longer.
CHUNK = 1 << 19


def byte_set(*ranges: tuple[int, int], negate: bool = False) -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return ~t if negate else t


#: What separates words of [^\x20\x09-\x0D]+, and bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
SPACED = byte_set((0x20, 0x20), (0x09, 0x0D), negate=True)
PLAIN = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), negate=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), so that every bit of a hash is usable."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def random_table(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U) + U(seed) * U(1000)) * BASE1)


TABLE1, TABLE2 = random_table(1), random_table(2)
#: Powers that a worker keeps at most, of each base.
KEPT = 2 << 20
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    key = (int(base), inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        one = U(pow(int(base), -1, 1 << 64)) if inverse else base
        x = np.full(max(n, 1 << 16), one, U)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= KEPT:
            _powers[key] = have
    return have[:n]


class SpanHash:
    """Hashes of any span [start, end) of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE1):
        n = len(values)
        self.base, self.sums = base, np.zeros(n + 1, U)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(self.base, len(self.sums), inverse=True)
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(U) * BASE2)


def grams(values: np.ndarray, k: int, base: np.uint64 = BASE1) -> np.ndarray:
    """Hash of each k consecutive values (length n-k+1)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k > 6:  # by prefix sums, whatever k
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * powers(base, len(values)), out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * powers(base, n, inverse=True))
    out = values[:n].copy()
    for j in range(1, k):
        out *= base
        out += values[j : n + j]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in time that doesn't depend on w."""
    n = len(x)
    if n < w:
        return x[:0]
    if w == 1:
        return x
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1 .. of counts[i] values each, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + shift


class Words:
    """Words of a chunk: byte bounds, 64-bit hashes and the word range of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool):
        if lower:
            data = LOWER[data]
        self.data, n = data, len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = keep[data] if n else False
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        starts[cuts] |= inside[1:-1][cuts]  # a word never runs on into the next document
        ends[cuts - 1] |= inside[1:-1][cuts - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)  # first word of each document, and the total
        self.count = np.diff(self.first)
        self.hash = SpanHash(TABLE1[data])(self.start, self.end) if len(self.start) else np.zeros(0, U)

    def room(self) -> np.ndarray:
        """How many words there are from each word to the end of its document."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits an array of texts (null: empty) into (from row, to row, bytes, offsets) of bounded size."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    body = texts.buffers()[2] if n else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
