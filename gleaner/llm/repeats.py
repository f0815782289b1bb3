"""Text repeated across documents: winnowed seeds, and the windows through them that also occur in a document of smaller id.

A unit is a byte or a word; a window is `length` units in a row. Of the k-grams inside a window the smallest by a fixed
order is its seed, so equal windows have equal seeds at equal places. Windows in a row with one seed are a segment, a
row (seed, hash of its content, document, place). This gives:

1. For each seed the smallest and largest document (a partial aggregate; hot seeds combine before the shuffle). Seeds of
   one document are done with.
2. Documents that share a seed are joined on it (a join that splits hot keys). Segments of equal content go on as one:
   outside the smallest document they are repeated as a whole.
3. Where a seed has several contents, the first document's segment of each one meets the others with its units, in
   buckets of bounded size, and the caller's own method says which windows are equal: by extending the seed both ways
   (seedextend.py) or by a suffix array (suffixdedup.py).
4. Seeds with more units than a bucket holds are lengthened: the windows through a seed are halved by where it lies in
   them, and what the windows of a half have in common is a longer seed, of which there are fewer each. At its longest a
   seed is a window, and windows are equal or not.

So copies, however many, cost narrow rows only, and units travel only for the edges of repeated passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.arrays import BASE1, BASE2, SPACED, TABLE1, SpanHash, U, Words, chunks, grams, mix, ranges, sliding_min
from gleaner.runtime import discard, prepare, settle

#: Bytes of a chunk for winnowing; about 200 bytes of memory for each.
STEP = 1 << 20
#: Bytes of segments that a task compares at a time, about, and those of one seed beyond which it is lengthened.
BUCKET, HOT = 2 << 20, 4 << 20


class Unit(NamedTuple):
    """What is compared: length of a window and of an anchor in units; words or bytes."""

    length: int
    anchor: int
    words: bool


class Chunk:
    """Units of some documents: two 64-bit values each, where documents start, and the segments of their windows."""

    def __init__(self, unit: Unit, data: np.ndarray, offsets: np.ndarray):
        self.unit, self.data, self.offsets = unit, data, offsets
        if unit.words:
            self.words = Words(data, offsets, SPACED, False)
            self.first, self.values = self.words.first, self.words.hash
        else:
            self.first, self.values = offsets, TABLE1[data]
        self.count = np.diff(self.first)

    def segments(self) -> tuple[np.ndarray, ...]:
        """(seed hash, content hash, document, place in it, windows, the seed's place in the first of them) of each segment."""
        length, k = self.unit.length, self.unit.anchor
        n = len(self.values)
        if n < length:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
        g = grams(self.values, k)
        if self.unit.words:  # long words first: they are rare, so few passages share an anchor by chance; gaps don't count
            total = np.concatenate(([0], np.cumsum(self.words.end - self.words.start)))
            size = total[k:] - total[:-k]
            order = ((63 - np.minimum(size, 63)).astype(np.uint64) << U(58)) | (mix(g ^ BASE2) >> U(6))
        else:
            order = mix(g ^ BASE2)
        order = (order & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        low = sliding_min(order, length - k + 1)
        room = np.repeat(self.first[1:], self.count)[: len(low)] - np.arange(len(low))
        at = np.flatnonzero(room >= length)
        if not len(at):
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
        anchor = (low[at] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        windows = np.diff(np.append(head, len(at)))
        start = at[head]
        content = SpanHash(self.values)(start, start + windows + length - 1)
        doc = np.searchsorted(self.first, start, "right") - 1
        return g[anchor[head]], content, doc, start - self.first[doc], windows, anchor[head] - start


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, tag (16 bits of the text's checksum: tells rows of equal doc_id apart), text; null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    # a bare column stays the same in every copy of the plan, so that exchanges can be shared
    key = F.col("doc_id") if docs.schema["doc_id"].dataType.typeName() == "long" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(key, F.crc32(text.cast("binary")).bitwiseAND(65535).alias("tag"), text.alias("text"))


def place(pos: np.ndarray, tag: np.ndarray, off: np.ndarray | int, windows: np.ndarray) -> np.ndarray:
    """A segment's place in one number: position, the document's tag, the seed's place in it, windows (both fewer than 256)."""
    return pos << 32 | tag << 16 | off << 8 | windows


def tag_of(p: str) -> F.Column:
    return F.shiftright(p, 16).bitwiseAND(65535).alias("tag")


def winnow(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in chunks(batch.column(2), STEP):
                a, s, doc, pos, n, off = Chunk(unit, data, offsets).segments()
                doc = doc + lo
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(ids[doc]), pa.array(place(pos, tags[doc], off, n))], names=["a", "s", "doc", "p"])

    return run


def placed(unit: Unit, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Chunks of rows (doc_id, tag, text, places) with the places' documents, positions, windows and (if places are
    pairs) second numbers; places that can't be the row's own are dropped."""
    for batch in batches:
        ids, tags, places = batch.column(0), batch.column(1).to_numpy(), batch.column(3)
        flat, size = places.flatten(), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = flat.flatten() if pa.types.is_struct(flat.type) else [flat]
        own_places, *seconds = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in parts)
        edge = np.concatenate(([0], np.cumsum(size)))
        for lo, hi, data, offsets in chunks(batch.column(2), STEP):
            c = Chunk(unit, data, offsets)
            own = own_places[edge[lo] : edge[hi]]
            doc = np.repeat(np.arange(hi - lo), size[lo:hi])
            pos, n = own >> 32, own & 255
            fits = pos + n + unit.length - 1 <= c.count[doc]
            yield c, ids.slice(lo, hi - lo), tags[lo:hi], doc[fits], pos[fits], n[fits], *(x[edge[lo] : edge[hi]][fits] for x in seconds)


def splittable(many: DataFrame, few: DataFrame, key: str, *more: str) -> DataFrame:
    """Joins rows to an aggregate of them. The key is altered, so that the aggregate's own partitioning doesn't serve the
    join: both sides are exchanged for it, the small one again, and Spark can then split hot keys of the large one."""
    turned = lambda df: df.withColumn(key, F.col(key).bitwiseXOR(1))
    return turned(turned(many).join(turned(few), [key, *more]))


SEEDS = "g long, lo int, hi int, doc long, p long, body binary"
Compare = Callable[[pa.Table], pa.Table]
#: settle() or settle_in_python().
Keep = Callable[..., DataFrame]


def bodies(unit: Unit):
    """From (doc_id, tag, text, pairs of place and seed) to SEEDS: the units of each segment (words with one space after
    each), lo and hi being the places that its seed may have in a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, ids, tags, doc, pos, n, off, g in placed(unit, batches):
            start, many = c.first[doc] + pos, n + unit.length - 1
            if unit.words:
                w = ranges(start, many)
                size = c.words.end[w] - c.words.start[w] + 1
                at = ranges(c.words.start[w], size)
                body = c.data[np.minimum(at, len(c.data) - 1)]
                body[np.cumsum(size) - 1] = 0x20
                edge = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(many)))]
            else:
                body, edge = c.data[ranges(start, many)], np.concatenate(([0], np.cumsum(many)))
            yield seeds(g, np.zeros(len(g), np.int32), np.full(len(g), unit.length - unit.anchor, np.int32), ids.take(pa.array(doc)), place(pos, tags[doc], off, n), body, edge)

    return run


def seeds(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: pa.Array, p: np.ndarray, body: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    kept = pa.Array.from_buffers(pa.large_binary(), len(g), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), doc, pa.array(p), kept], names=["g", "lo", "hi", "doc", "p", "body"])


def opened(unit: Unit, rows: pa.RecordBatch | pa.Table) -> Chunk:
    """The units of SEEDS rows, each row as a document of the chunk."""
    body = rows.column("body")
    body = pa.chunked_array([x.cast(pa.large_binary()) for x in (body.chunks if isinstance(body, pa.ChunkedArray) else [body])], pa.large_binary()).combine_chunks()
    if isinstance(body, pa.ChunkedArray):
        body = body.chunk(0) if body.num_chunks else pa.array([], pa.large_binary())
    offsets = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, body.offset * 8) if len(body) else np.zeros(1, np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(body) else np.zeros(0, np.uint8)
    return Chunk(unit, data, offsets - offsets[0])


def lengthen(unit: Unit):
    """From SEEDS to SEEDS: a row for each half of the windows that it has some of, with the longer seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, doc = opened(unit, batch), batch.column("doc")
            g, lo, hi, p = (batch.column(x).to_numpy().astype(np.int64) for x in ("g", "lo", "hi", "p"))
            off, n, first = p >> 8 & 255, p & 255, c.first[:-1]
            hashed = SpanHash(c.values)
            for x, y in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)):
                begin, end = np.maximum(off - y, 0), np.minimum(off - x + 1, n)
                some = np.flatnonzero((begin < end) & (x <= y))
                b, e, o, f = begin[some], end[some], off[some], first[some]
                seed = hashed(f + o - x[some], f + o - y[some] + unit.length)
                longer = mix(seed ^ mix(g[some].view(np.uint64) + (x[some] * 256 + y[some]).astype(np.uint64) * BASE1))
                units = np.stack((f + b, f + e + unit.length - 1))
                at, to = (c.words.start[units[0]], np.append(c.words.start, len(c.data))[units[1]]) if unit.words else units
                yield seeds(longer.view(np.int64), x[some], y[some], doc.take(pa.array(some)), ((p[some] >> 32) + b) << 32 | p[some] & 0xFFFF0000 | (o - b) << 8 | e - b, c.data[ranges(at, to - at)], np.concatenate(([0], np.cumsum(to - at))))

    return run


def shared(first: DataFrame, docs: DataFrame, unit: Unit, compare: Compare, bucket: int, hot: int, keep: Keep) -> DataFrame:
    """The windows of segments (a, doc, p) that a smaller document's segment of equal seed also has, as (doc, p)."""
    places = first.groupBy(F.col("doc").alias("doc_id"), tag_of("p")).agg(F.collect_list(F.struct("p", F.shiftright("p", 8).bitwiseAND(255).alias("off"), "a")).alias("places"))
    rows = keep(docs.join(places, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places"), "seeds", bodies(unit), SEEDS)
    out = None
    while True:
        sizes = rows.groupBy("g").agg(F.sum(F.length("body")).alias("bytes"), F.max("hi").alias("hi"), F.max("lo").alias("lo"))
        total, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
        large = sizes.where(F.col("bytes") > hot) if (most or 0) > hot else None
        cold = rows if large is None else rows.join(large.select("g"), "g", "left_anti")
        buckets = max(1, -(-(total or 0) // bucket))
        found = cold.withColumn("bucket", F.pmod("g", F.lit(buckets))).groupBy("bucket").applyInArrow(compare, "doc long, p long")
        out = found if out is None else out.unionByName(found)
        if large is None:
            return out
        windows = rows.join(large.where("lo = hi").select("g"), "g", "left_semi")  # all of them equal but for hashes
        least = windows.groupBy("g", "body").agg(F.min("doc").alias("low"))
        out = out.unionByName(splittable(windows, least, "g", "body").where("doc > low").select("doc", "p"))
        rows = keep(rows.join(large.where("lo < hi").select("g"), "g", "left_semi"), "seeds", lengthen(unit), SEEDS)


def repeated(docs: DataFrame, unit: Unit, compare: Compare, bucket: int = BUCKET, hot: int = HOT, keep: Keep = settle) -> DataFrame:
    """Rows (doc_id, tag, places): every window of narrow(docs) that also starts in a document of smaller id.

    Rows with a null doc_id neither have nor give repeats; those of equal doc_id don't repeat each other.
    """
    prepare(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    seen = docs.mapInArrow(winnow(unit), "a long, s long, doc long, p long")
    anchors = seen.groupBy("a").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("a")
    met = keep(splittable(seen, anchors, "a").select("a", "s", "doc", "p"), "segments")
    contents = met.groupBy("a", "s").agg(F.min("doc").alias("low"))
    several = contents.groupBy("a").agg((F.count("*") > 1).alias("several"))
    marked = keep(splittable(met, splittable(contents, several, "a"), "a", "s").where("several or doc > low"), "marked")
    discard(met)
    rows = marked.where("doc > low").select("doc", "p").unionByName(shared(marked.where("doc = low").select("a", "doc", "p"), docs, unit, compare, bucket, hot, keep))
    return rows.groupBy(F.col("doc").alias("doc_id"), tag_of("p")).agg(F.collect_list("p").alias("places"))
