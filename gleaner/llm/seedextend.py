"""Substring dedup by seed and extend, on words.

Seeds are winnowed pairs of words. Documents that share a seed are joined on it (repeats.py), and each seed is extended
word by word to the left and to the right in all of them at once: documents stay together as long as their words agree,
and one that is left alone is done with. So a seed has classes of documents for every number of words to its left, and
such classes to its right; a window of 13 words through the seed is repeated if a document of smaller id is in the same
class on both sides. Windows in a row unite into maximal repeats, none shorter than 13 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.arrays import ranges
from gleaner.llm.repeats import BUCKET, HOT, Compare, Unit, narrow, opened, place, placed, repeated
from gleaner.runtime import settle_in_python, table

#: Words of the shortest repeat, and of a seed.
LENGTH, SEED = 13, 2


def together(*keys: np.ndarray) -> np.ndarray:
    """A number for each distinct combination of keys; -1 where it occurs once or some key is negative."""
    out = np.full(len(keys[0]), -1, np.int64)
    some = np.flatnonzero(np.all([k >= 0 for k in keys], axis=0))
    if len(some):
        one = keys[0][some]
        for k in keys[1:]:
            one = one * (int(k[some].max()) + 1) + k[some]
        _, which, count = np.unique(one, return_inverse=True, return_counts=True)
        out[some] = np.where(count[which] > 1, which, -1)
    return out


def extend(unit: Unit) -> Compare:
    """A bucket of segments (all of a seed are in it) to the windows that a smaller document also has, as runs (doc, p)."""

    def run(bucket: pa.Table) -> pa.Table:
        c = opened(unit, bucket)
        g, doc, p = (bucket.column(x).to_numpy() for x in ("g", "doc", "p"))
        _, word = np.unique(c.values, return_inverse=True)
        off, n, rest = p >> 8 & 255, p & 255, unit.length - unit.anchor
        at, m = c.first[:-1] + off, len(g)
        seed = together(np.unique(g, return_inverse=True)[1])
        left, right = [seed], [seed]
        for side, step, room in ((left, -1, off), (right, 1, c.count - off - unit.anchor)):
            for j in range(rest):
                next_ = at - 1 - j if step < 0 else at + unit.anchor + j
                side.append(together(side[j], np.where(room > j, word[np.clip(next_, 0, len(word) - 1)], -1)))
        again = np.zeros((m, rest + 1), bool)
        for o in range(rest + 1):
            has = (off >= o) & (off - o < n)
            same = together(np.where(has, left[o], -1), right[rest - o])
            some = np.flatnonzero(same >= 0)
            low = np.full(m + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, same[some], doc[some])
            hit = some[doc[some] > low[same[some]]]
            again[hit, off[hit] - o] = True
        edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.table({"doc": doc[row], "p": place((p[row] >> 32) + a, p[row] >> 16 & 65535, 0, b - a)})

    return run


def covered(first: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of the chunk's units lie in some window of the places."""
    edge = np.zeros(total + 1, np.int64)
    start = first[doc] + pos
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values; none goes over the start of a document."""
    n = len(mask)
    begin, stop = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    stop[:-1] &= ~mask[1:]
    cut = first[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = mask[cut]
    stop[cut - 1] = mask[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def strip(unit: Unit):
    """From (doc_id, tag, text, places) to what is left of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, ids, _, doc, pos, n in placed(unit, batches):
            w, docs = c.words, len(ids)
            gone = covered(c.first, doc, pos, n, unit.length, len(w.start))
            keep = np.flatnonzero(~gone)
            size = w.end[keep] - w.start[keep] + 1
            text = c.data[np.minimum(ranges(w.start[keep], size), len(c.data) - 1)]
            text[np.cumsum(size) - 1] = 0x20
            cut = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(keep, c.first)]
            raw = text.tobytes()
            left = [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), c.first[:-1]) * (c.count > 0)
            begin, stop = runs(gone, c.first)
            of = np.searchsorted(c.first, begin, "right") - 1
            spans = np.stack((begin - c.first[of], stop - c.first[of]), axis=1).ravel()
            bound = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=docs)))) * 2
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(c.count, pa.int64()), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(spans, pa.int64())), pa.array(left, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return run


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Every document with its places; none is an empty list. Rows without an id go beside the join, so that the others
    are read by the very plan that finds their places, and the exchange of their texts is shared with it."""
    none = F.array().cast("array<bigint>")
    joined = docs.where("doc_id is not null").join(places, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", F.coalesce("places", none).alias("places"))
    return joined.unionByName(docs.where("doc_id is null").withColumn("places", none))


def dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, spans (from, to word indexes of the maximal repeats
    removed, flat), kept (the other words, joined by a space).

    Null texts have no words. Rows with a null doc_id stay whole and give no repeats; rows of equal doc_id are
    compared with smaller ids only, not with each other. An empty table gives no rows; extra columns aren't read.
    """
    unit, slim = Unit(length, seed, True), narrow(docs)
    return with_places(slim, repeated(slim, unit, extend(unit), bucket, hot, settle_in_python)).mapInArrow(strip(unit), "doc_id long, n_words long, n_removed long, spans array<long>, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def plain(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same by brute force, for tests."""
    words = [(d, [w for w in _split(t or "")]) for d, t in rows]
    low: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            low[g] = min(low.get(g, d), d)
    out = []
    for d, w in words:
        gone = {i + j for i in range(len(w) - length + 1) if low[tuple(w[i : i + length])] < d for j in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _split(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE low < doc_id),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT e.doc_id, count(gone.j) AS n_removed, string_agg(x, ' ' ORDER BY e.j) FILTER (WHERE gone.j IS NULL) AS kept FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.j = gone.j GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
