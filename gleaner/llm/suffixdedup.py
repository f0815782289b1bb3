"""Suffix-array dedup of bytes, by two-stage sorting.

Windows of 100 bytes that may repeat are narrowed down by winnowed seeds (repeats.py); what must be compared window by
window, distinct contents of shared seeds, goes to buckets by seed, so equal windows meet in one bucket. There the
segments are laid end to end and their suffixes sorted in two stages: those smaller than their successors directly, the
rest induced by one scan over the buckets of first bytes. Neighbours with a common prefix of 100 bytes or more are equal
windows. Repeats inside one document are found in the same way, by an array of those of its segments whose seed it has twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.arrays import TABLE1, SpanHash, mix, ranges
from gleaner.llm.repeats import BUCKET, HOT, Chunk, Compare, Unit, narrow, opened, place, placed, repeated
from gleaner.llm.seedextend import covered, runs, with_places
from gleaner.runtime import table

#: Bytes of the shortest repeat, and of an anchor.
LENGTH, ANCHOR = 100, 24
SEPARATOR = 0xFF  # in no UTF-8 text


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number (zeros after the end)."""
    out = np.zeros(len(text), np.uint64)
    for j in range(min(8, len(text))):
        part = text[j:].astype(np.uint64)
        out[: len(text) - j] |= part << np.uint64(56 - 8 * j)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the last one isn't)."""
    n = len(text)
    head = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    up = np.zeros(len(head), bool)
    up[:-1] = text[head[:-1]] < text[head[1:]]
    return np.repeat(up, np.diff(np.append(head, n)))


def direct(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes `at` sorted by their first `depth` bytes or more; only ties are looked at again."""
    order = at[np.argsort(keys[at], kind="stable")]
    k = keys[order]
    group = np.cumsum(np.concatenate(([0], k[1:] != k[:-1]))) if len(at) else np.zeros(0, np.int64)
    n = len(keys)
    for d in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        live = np.flatnonzero(tied)
        if not len(live):
            break
        own = order[live]
        k = np.where(own + d < n, keys[np.minimum(own + d, n - 1)], np.uint64(0))
        sort = np.lexsort((k, group[live]))
        order[live], k = own[sort], k[sort]
        split = np.concatenate(([False], group[1:] != group[:-1]))
        split[live[1:]] |= k[1:] != k[:-1]
        group = np.cumsum(split)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of the bytes, sorted by their first `depth` bytes at least (two-stage sorting)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(text)
    keys = words8(text)
    ready = direct(np.flatnonzero(small), keys, depth)
    cut = np.searchsorted(text[ready], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = text[before]
            if len(before) > 1:
                sort = np.argsort(first, kind="stable")
                before, first = before[sort], first[sort]
            edge = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(before)], strict=True):
                queues[first[a]].append(before[a:b])

    queues[text[-1]].append(np.array([n - 1]))  # larger than the empty suffix after it
    out = []
    for c in range(256):
        k = 0
        while k < len(queues[c]):
            out.append(queues[c][k])
            induce(queues[c][k])
            k += 1
        direct_part = ready[cut[c] : cut[c + 1]]
        if len(direct_part):
            out.append(direct_part)
            induce(direct_part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it, counted up to `most` (the first: 0)."""
    keys, n = words8(text), len(text)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(0, most, 8):
        x, y = order[live] + d, order[live - 1] + d
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        diff = keys[x] ^ keys[y]
        same = diff == 0
        out[live[~same]] = d + (diff[~same].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        out[live[same]] = d + 8
        live = live[same]
    out[1:] = np.minimum(out[1:], n - np.maximum(order[1:], order[:-1]))  # zeros after the end aren't bytes
    return np.minimum(out, most)


def repeats_among(flat: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int, order: np.ndarray, alone: np.ndarray | None = None) -> np.ndarray:
    """Which windows of the segments (n windows each, from begin) equal another window whose segment is smaller by
    `order`; only those of equal `alone`, if it is given, and then by place too. The result has a value for each window, end to end."""
    again = np.zeros(int(n.sum()), bool)
    # segments none of whose windows has the hash of another one can't repeat: the array is of the others
    start, owner = ranges(begin, n), np.repeat(np.arange(len(n)), n)
    hashed = SpanHash(TABLE1[flat])(start, start + length)
    if alone is not None:
        hashed = mix(hashed + alone[owner].astype(np.uint64))
    _, which, count = np.unique(hashed, return_inverse=True, return_counts=True)
    some = np.unique(owner[count[which] > 1])
    if not len(some):
        return again
    size = n[some] + length
    text = np.full(int(size.sum()), SEPARATOR, np.uint8)
    first = np.cumsum(size) - size
    text[ranges(first, size - 1)] = flat[ranges(begin[some], size - 1)]
    of = np.repeat(np.arange(len(some)), size)
    array = suffix_array(text, length)
    array = array[(np.arange(len(text)) - first[of] < n[some][of])[array]]
    group = np.cumsum(common_prefixes(text, array, length) < length)
    seg = some[of[array]]
    at = array - first[of[array]]
    if alone is None:
        rank = order[seg]
    else:
        group = np.unique(np.stack((group, alone[seg])), axis=1, return_inverse=True)[1].ravel()
        rank = begin[seg] + at
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank)
    hit = rank > least[group]
    again[(np.cumsum(n) - n)[seg[hit]] + at[hit]] = True
    return again


def compare(unit: Unit) -> Compare:
    """A bucket of segments to the windows that a smaller document's segment also has, as runs (doc, p)."""

    def run(bucket: pa.Table) -> pa.Table:
        c = opened(unit, bucket)
        doc, p = (bucket.column(x).to_numpy() for x in ("doc", "p"))
        n = p & 255
        again = repeats_among(c.data, c.first[:-1], n, unit.length, doc)
        bound = np.concatenate(([0], np.cumsum(n)))
        a, b = runs(again, bound)
        of = np.searchsorted(bound, a, "right") - 1
        return pa.table({"doc": doc[of], "p": place((p[of] >> 32) + a - bound[of], p[of] >> 16 & 65535, 0, b - a)})

    return run


def inside(c: Chunk) -> np.ndarray:
    """Bytes of the chunk in a window that also starts earlier in the same document."""
    length, total = c.unit.length, len(c.values)
    a, content, doc, pos, n, _ = c.segments()
    if not len(a):
        return np.zeros(total, bool)
    order = np.lexsort((pos, content, a, doc))
    new = np.ones((2, len(order)), bool)  # another seed or document; another content besides
    new[0, 1:] = (a[order][1:] != a[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    new[1, 1:] = new[0, 1:] | (content[order][1:] != content[order][:-1])
    seed = np.cumsum(new[0]) - 1
    several = (np.bincount(seed, weights=new[1]) > 1)[seed]
    copies, firsts = order[~new[1]], order[new[1] & several]
    begin = c.first[doc] + pos
    hit = [ranges(begin[copies], n[copies])]  # segments of equal content go on as one
    if len(firsts):
        own = begin[firsts]
        hit.append(ranges(own, n[firsts])[repeats_among(c.data, own, n[firsts], length, own, doc[firsts])])
    edge = np.zeros(total + 1, np.int64)
    for h in hit:
        np.add.at(edge, h, 1)
        np.add.at(edge, h + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return gone


def strip(unit: Unit):
    """From (doc_id, tag, text, places) to what is left of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, ids, _, doc, pos, n in placed(unit, batches):
            docs = len(ids)
            gone = covered(c.first, doc, pos, n, unit.length, len(c.data)) | inside(c)
            begin, stop = runs(gone, c.first)
            of = np.searchsorted(c.first, begin, "right") - 1
            n_spans = np.bincount(of, minlength=docs)
            n_removed = np.bincount(of, weights=stop - begin, minlength=docs).astype(np.int64)
            spans = np.stack((begin - c.first[of], stop - c.first[of]), axis=1).ravel()
            raw = c.data[~gone].tobytes()
            cut = np.concatenate(([0], np.cumsum(c.count - n_removed))).tolist()
            left = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(c.count, pa.int64()), pa.array(n_removed), pa.array(n_spans, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_spans))) * 2, pa.int32()), pa.array(spans, pa.int64())), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, spans (from, to byte offsets of the maximal
    removed runs, flat), kept (the other bytes; a cut may fall inside a character).

    Null texts are empty. Rows with a null doc_id are only compared with themselves; those of equal doc_id aren't
    compared with each other. An empty table gives no rows; extra columns aren't read.
    """
    unit, slim = Unit(length, anchor, False), narrow(docs)
    places = repeated(slim, unit, compare(unit), bucket, hot)
    return with_places(slim, places).mapInArrow(strip(unit), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def plain(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same by brute force, for tests."""
    out, seen = [], set()
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


# Windows are told apart by a digest of their hexadecimal form, cut from blocks of 500 bytes, so that no text is walked once for each window.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, 500 * k AS base, substr(h, 1000 * k + 1, 1198) AS s FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 499) // 500)) AS k FROM d)),
w AS (SELECT doc_id, base + j AS i, md5(substr(s, 2 * j + 1, 200)) AS m FROM (SELECT doc_id, base, s, unnest(range(0, least(500, len(s) // 2 - 99))) AS j FROM b)),
f AS (SELECT m, min_by((doc_id, i), (doc_id, i)) AS least FROM w GROUP BY m),
r AS (SELECT doc_id, i FROM w JOIN f USING (m) WHERE (doc_id, i) <> least),
e AS (SELECT doc_id, i, lag(i) OVER o AS before, lead(i) OVER o AS after FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT doc_id, i AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e WHERE before IS NULL OR i > before + 100),
y AS (SELECT doc_id, i + 100 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e WHERE after IS NULL OR after > i + 100),
p AS (SELECT doc_id, k, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS left_from FROM x JOIN y USING (doc_id, k)),
g AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, list((left_from, a) ORDER BY k) AS cuts FROM p GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(cuts, lambda c: substr(h, 2 * c[1] + 1, 2 * (c[2] - c[1]))), ''), '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
