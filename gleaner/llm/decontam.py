"""Benchmark decontamination with suffix arrays of the training text.

Every chunk of documents (a shard) sorts the suffixes of all its words into a suffix array. Every suffix of the
benchmark's items is then looked up in it by binary search, one word deeper at a time, until its range of matches is
empty: the depth reached is its longest verbatim match, and the range at the window's depth gives the places to mark.
Words are compared by 64-bit hashes, and places that are marked then word by word.

The benchmark is the stated query set. It goes to the executors as broadcast blocks, up to a bound (PASS) for one pass over
the documents, which all its blocks share; only what is beyond needs another pass, and rows of several passes are united
by a key of their own. Nothing but what is found leaves a task, so one pass has no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.arrays import LOWER, PLAIN, Words, chunks, ranges
from gleaner.runtime import prepare, settle, table

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in a block (at least one item; about eight times that when it is searched), and of all blocks
#: that are broadcast for one pass over the documents.
BLOCK, PASS = 8 << 20, 256 << 20
#: Bytes of documents in a shard, and in those that a task holds while it goes through several blocks.
SHARD, HELD = 2 << 20, 8 << 20
Item = tuple[str | None, str]


class Suffixes:
    """Suffixes of the words of some texts: where they start, how long they are, and what they belong to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets, PLAIN, True)
        self.hash, self.start, self.end, self.first, self.count = w.hash, w.start, w.end, w.first, w.count
        self.room, self.of = w.room(), np.repeat(np.arange(len(w.count)), w.count)
        self.data = LOWER[data]


class Block(Suffixes):
    """All suffixes of some benchmark items."""

    def __init__(self, items: list[Item], window: int):
        self.ids = [i for i, _ in items]
        for _, _, data, offsets in chunks(pa.array([t for _, t in items], pa.large_string()), 1 << 60):
            super().__init__(data, offsets)
        self.need = np.minimum(self.count, window)[self.of]


class Shard(Suffixes):
    """A chunk of documents, its suffix array, and what has been found in it so far."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        self.array = suffix_array(self.hash, self.room)
        self.hit = np.zeros(len(self.hash), bool)
        self.longest = np.zeros(len(self.count), np.int64)
        self.items: list[set[str]] = [set() for _ in self.count]

    def look_up(self, block: Block) -> None:
        found = search(self, block)
        # the range of a deeper match lies within those of its prefixes: painted by depth, the deepest one stays
        depth, lo, hi = np.unique(np.stack([found[k] for k in ("longest", "last_lo", "last_hi")]), axis=1)
        deep = np.zeros(len(self.array), np.int64)
        deep[ranges(lo, hi - lo)] = np.repeat(depth, hi - lo)
        np.maximum.at(self.longest, self.of[self.array], deep)
        use = np.flatnonzero(found["hi"] > found["lo"])
        # equal windows have one range: its places are looked at once, whatever number of items hold the window
        spots, which = np.unique(np.stack((found["lo"][use], found["hi"][use], block.need[use])), axis=1, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        bound = np.searchsorted(which[order], np.arange(spots.shape[1] + 1))
        for k, (lo, hi, n) in enumerate(spots.T.tolist()):
            tests = use[order[bound[k] : bound[k + 1]]]
            names = {block.ids[i] for i in np.unique(block.of[tests]).tolist()} - {None}
            at = self.array[lo:hi]
            for j in range(n):  # word by word
                word = block.data[block.start[tests[0] + j] : block.end[tests[0] + j]]
                at = at[self.end[at + j] - self.start[at + j] == len(word)]
                at = at[(self.data[self.start[at + j][:, None] + np.arange(len(word))] == word).all(axis=1)]
            for j in range(n):
                self.hit[at + j] = True
            for d in np.unique(self.of[at]).tolist():
                self.items[d] |= names

    def rows(self) -> list[pa.Array]:
        """n_words, n_hit, items, spans, longest of each document."""
        edge = np.diff(np.concatenate(([0], self.hit.view(np.int8), [0])))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans: list[list[int]] = [[] for _ in self.count]
        for x, y in zip(begin.tolist(), stop.tolist(), strict=True):  # a run may go on into the next document
            while x < y:
                d = int(self.of[x])
                z = min(y, int(self.first[d + 1]))
                spans[d] += [x - int(self.first[d]), z - int(self.first[d])]
                x = z
        hits = np.bincount(self.of[self.hit], minlength=len(self.count))
        return [pa.array(self.count, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(x) for x in self.items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64())), pa.array(self.longest)]


def suffix_array(words: np.ndarray, room: np.ndarray) -> np.ndarray:
    """All suffixes, sorted by their words (shorter ones first). Prefix doubling on those that are still tied."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    new = np.concatenate(([True], words[order[1:]] != words[order[:-1]]))
    rank = np.zeros(n + 1, np.int64)  # of each suffix by its first `depth` words; the one after the last is empty
    rank[order] = np.cumsum(new)
    depth = 1
    while True:
        tied = np.zeros(n, bool)
        tied[1:] |= ~new[1:]
        tied[:-1] |= ~new[1:]
        live = np.flatnonzero(tied)
        live = live[room[order[live]] > 0]
        own = order[live]
        next_ = np.where(room[own] > depth, rank[np.minimum(own + depth, n)], 0)
        if not len(live) or not (room[own] > depth).any():
            return order
        sort = np.lexsort((next_, rank[own]))
        order[live] = own[sort]
        split = np.concatenate(([True], (rank[own[sort]][1:] != rank[own[sort]][:-1]) | (next_[sort][1:] != next_[sort][:-1])))
        new[live] = split
        # ranks are places of group heads, so that those of other groups stay as they are
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head + 1
        depth *= 2


def bound(shard: Shard, lo: np.ndarray, hi: np.ndarray, depth: int, target: np.ndarray, right: bool) -> np.ndarray:
    """In [lo, hi) of the suffix array, whose suffixes agree up to depth: the first one whose word there isn't below
    (right: is above) the target."""
    lo, hi, words, room, array = lo.copy(), hi.copy(), shard.hash, shard.room, shard.array
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        s = array[mid]
        ended = room[s] <= depth
        w = words[np.where(ended, 0, s + depth)]
        t = target[live]
        below = ended | ((w <= t) if right else (w < t))
        lo[live] = np.where(below, mid + 1, lo[live])
        hi[live] = np.where(below, hi[live], mid)


def search(shard: Shard, block: Block) -> dict[str, np.ndarray]:
    """For every benchmark suffix: its longest match and the range of the suffix array that has it, and the range that
    agrees for a whole window (empty if none does)."""
    many = len(block.hash)
    lo, hi, live, depth = np.zeros(many, np.int64), np.full(many, len(shard.array)), np.arange(many), 0
    out = {k: np.zeros(many, np.int64) for k in ("longest", "last_lo", "last_hi", "lo", "hi")}
    while len(live):
        target = block.hash[live + depth]
        lo, hi = bound(shard, lo, hi, depth, target, False), bound(shard, lo, hi, depth, target, True)
        depth += 1
        some = lo < hi
        lo, hi, live = lo[some], hi[some], live[some]
        out["longest"][live], out["last_lo"][live], out["last_hi"][live] = depth, lo, hi
        done = block.need[live] == depth
        out["lo"][live[done]], out["hi"][live[done]] = lo[done], hi[done]
        more = block.room[live] > depth
        lo, hi, live = lo[more], hi[more], live[more]
    return out


_open: dict = {}


def opened(block: Broadcast, window: int) -> Block:
    """A worker keeps one block open."""
    if _open.get("of") != (block, window):
        _open.update(of=(block, window), block=Block(block.value, window))
    return _open["block"]


def shards(batches: Iterator[pa.RecordBatch], text: int, blocks: list[Broadcast], window: int) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Rows with their shards, looked up in all blocks; some shards are held so that a block is opened once for them."""
    held: list[tuple[pa.RecordBatch, Shard]] = []
    size = 0

    def ready() -> Iterator[tuple[pa.RecordBatch, Shard]]:
        for b in blocks:
            block = opened(b, window)
            for _, shard in held:
                shard.look_up(block)
        yield from held

    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(text), SHARD):
            held.append((batch.slice(lo, hi - lo), Shard(data, offsets)))
            size += len(data)
            if len(blocks) < 2 or size >= HELD:
                yield from ready()
                held, size = [], 0
    yield from ready()


FOUND = ["n_words", "n_hit", "items", "spans", "longest"]


def scan(blocks: list[Broadcast], window: int):
    """A mapInArrow function from (key, doc_id, text) to (key, doc_id) and FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shard in shards(batches, 2, blocks, window):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *shard.rows()], names=["key", "doc_id", *FOUND])

    return run


def passes(benchmark: DataFrame, window: int, block_bytes: int, pass_bytes: int) -> list[list[Broadcast]]:
    """The benchmark's items in broadcast blocks of bounded size, and those in passes of bounded size. Items are never cut."""
    sc, out, held, size, total = benchmark.sparkSession.sparkContext, [[]], [], 0, 0

    def close() -> None:
        nonlocal held, size, total
        if out[-1] and total + size > pass_bytes:
            out.append([])
            total = 0
        out[-1].append(sc.broadcast(held))
        held, size, total = [], 0, total + size

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).where(F.col("text").isNotNull())
    for i, text in rows.toLocalIterator():
        if held and size + len(text) > block_bytes:
            close()
        held.append((i, text))
        size += len(text)
    if held:
        close()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK, pass_bytes: int = PASS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (sorted ids of the items with a window in it), spans
    (from, to word indexes of the hit runs, flat), longest (the longest verbatim match with any item, in words).

    Null texts have no words and no hits; benchmark rows with null text are passed over, those with a null id mark
    words but aren't listed. Rows of null or equal doc_id and repeated items each count by themselves, whatever number of
    blocks or passes the benchmark takes. Empty tables give no rows or no hits. Extra columns of either table aren't read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<long>, longest long"
    groups = passes(benchmark, window, block_bytes, pass_bytes)
    if len(groups) == 1:
        slim = docs.select(F.lit(0).cast("long").alias("key"), "doc_id", "text")
        return slim.mapInArrow(scan(groups[0], window), schema).drop("key")
    slim = settle(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "keyed")
    every = None
    for blocks in groups:
        part = settle(slim.mapInArrow(scan(blocks, window), schema), "decontam")
        every = part if every is None else every.unionByName(part)
    lists = every.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"), F.max("longest").alias("longest"))
    return lists.drop("key").mapInArrow(united, schema.removeprefix("key long, "))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of what several passes found in a document: ids and hit runs united."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            runs: list[list[int]] = []
            for a, b in sorted(p for s in r["spans"] for p in zip(s[::2], s[1::2], strict=True)):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            out.append((r["n_words"], sum(b - a for a, b in runs), sorted({i for x in r["items"] for i in x}), [x for p in runs for x in p], r["longest"]))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *FOUND])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK, pass_bytes: int = PASS) -> DataFrame:
    """Documents without those that hold a window of some item; all columns stay.

    Rows are judged by their text alone, whatever their doc_id and however often they occur. Null and empty texts hold
    no window and stay. An empty table gives no rows; with an empty benchmark all stay.
    """
    prepare(docs.sparkSession)
    out, at = docs, docs.columns.index("text")
    for blocks in passes(benchmark, window, block_bytes, pass_bytes):
        out = out.mapInArrow(clean(blocks, window, at), docs.schema)
    return out


def clean(blocks: list[Broadcast], window: int, text: int):
    """A mapInArrow function that passes on the rows whose text holds no window of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shard in shards(batches, text, blocks, window):
            yield rows.filter(pa.array(np.bincount(shard.of[shard.hit], minlength=rows.num_rows) == 0))

    return run


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n FROM dw SEMI JOIN bw USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM dw JOIN bw USING (n, g)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
"""
