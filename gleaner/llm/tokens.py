"""Token ids by a byte-level BPE of the tokenizers library, fast enough for whole corpora.

The library's split pattern is applied to a chunk of documents at once on arrays of code points; the library itself
encodes each distinct word of a chunk once, and what it gave is kept from chunk to chunk. Texts with characters
whose class may depend on a Unicode version (or with the strings of special tokens) go to the library whole, so ids
are the library's own in every case.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.llm.arrays import SpanHash, mix, ranges

SPACE, LETTER, NUMBER, OTHER, END, UNSURE = range(6)
#: Words whose ids a worker remembers; beyond it starts afresh.
REMEMBERED = 2_000_000
#: Characters of text worked on at once.
STEP = 1 << 20


def classes() -> np.ndarray:
    """The class of each code point below 0x3000 that the split pattern asks for; UNSURE where it isn't old and plain."""
    t = np.full(0x3000, UNSURE, np.uint8)
    for c in [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203F), *range(0x20A0, 0x20AD), 0x2122]:
        kind = unicodedata.category(chr(c))[0]
        t[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    t[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    return t


CLASS = classes()
QUOTE = ord("'")
AFTER = {ord(c): 2 for c in "stmd"}
AFTER2 = {(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))}


def split(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where tokens' words start, by the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    Every document ends with one point of kind END, which is a word by itself."""
    n = len(points)
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    blank = np.zeros(n, bool)
    blank[1:] = points[:-1] == 0x20
    solid = (kind != SPACE) & (kind != END)
    start = new & ~(blank & solid)
    # the last space of a run that something follows is not part of the run
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & solid[1:]
    start |= last
    quote = np.flatnonzero((points == QUOTE) & start)
    quote = quote[quote + 2 < n]
    if len(quote):
        a, b = points[quote + 1], points[quote + 2]
        one = np.isin(a, list(AFTER))
        two = np.zeros(len(quote), bool)
        for x, y in AFTER2:
            two |= (a == x) & (b == y)
        for at, length in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            to = at + length
            start[to[kind[to] == LETTER]] = True
    return start


class Encoder:
    """encode(texts): the ids of all texts end to end, and how many each has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        held, total = [], 0
        for t in texts:
            held.append(t)
            total += len(t)
            if total >= STEP:
                for x, y in zip((ids, counts), self.step(held), strict=True):
                    x.append(y)
                held, total = [], 0
        if held:
            for x, y in zip((ids, counts), self.step(held), strict=True):
                x.append(y)
        return np.concatenate(ids), np.concatenate(counts)

    def step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        kind = np.where(points < len(CLASS), CLASS[np.minimum(points, len(CLASS) - 1)], UNSURE)
        kind[ends] = END
        odd = np.add.reduceat(kind == UNSURE, ends - lengths) > 0 if len(texts) else np.zeros(0, bool)
        for s in self.special:
            if s in joined:
                odd |= np.fromiter((s in t for t in texts), bool, len(texts))
        if odd.any():
            return self.mixed(texts, odd)
        start = np.flatnonzero(split(points, kind))
        stop = np.append(start[1:], len(points))
        word = kind[start] != END
        owner = np.cumsum(~word) - (~word)
        start, stop, owner = start[word], stop[word], owner[word]
        hashes = SpanHash(mix(points.astype(np.uint64) + np.uint64(77)))(start, stop)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, size = self.known(distinct, lambda new: [joined[a:b] for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
        n = size[which]
        ids = self.pool[ranges(at[which], n)]
        return ids, np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)

    def known(self, keys: np.ndarray, words: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key (sorted, distinct) lie in the pool; new ones are encoded first."""
        if len(self.keys) > REMEMBERED:
            self.forget()
        pos = np.searchsorted(self.keys, keys)
        have = self.keys[np.minimum(pos, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~have)
        if len(new):
            got = self.batch(words(new))
            size = np.fromiter(map(len, got), np.int64, len(got))
            at = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate((self.pool, np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))))
            insert = pos[new]
            self.keys = np.insert(self.keys, insert, keys[new])
            self.at, self.size = np.insert(self.at, insert, at), np.insert(self.size, insert, size)
            pos = np.searchsorted(self.keys, keys)
        return self.at[pos], self.size[pos]

    def mixed(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = [t for t, o in zip(texts, odd.tolist(), strict=True) if not o]
        ids, counts = self.step(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        parts, ends, k, out = np.split(ids, np.cumsum(counts)[:-1]) if plain else [], np.zeros(len(texts), np.int64), 0, []
        for i, o in enumerate(odd.tolist()):
            if o:
                out.append(np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32))
            else:
                out.append(parts[k])
                k += 1
            ends[i] = len(out[-1])
        return np.concatenate(out), ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts_of(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def default_path() -> str:
    """The public byte-level vocabulary of 50,257 ids; a file on every machine, found again where it is used."""
    if "public_tokenizers" not in sys.modules:
        import public_tokenizers  # noqa: F401
    return sys.modules["public_tokenizers"].path("byte_bpe_50k.json")
