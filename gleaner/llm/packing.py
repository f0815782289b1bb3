"""Packing documents into sequences of equal cost.

A document's ids are cut after every 2048 ids where its text is tokenised, so ids never travel: only narrow rows of
pieces do. Pieces are dealt to groups of bounded size, and each group is packed by itself: it has as many sequences as
its ids fill, and pieces in descending order of cost (linear plus quadratic in length: attention stays within a piece)
each go to the lowest-cost sequence that still has room. A piece that has room nowhere is cut to fill the widest room,
and the rest of it waits for its turn. Cuts lie at multiples of GRID ids, of which the checksums are kept, so the
checksum of any part is put together without its ids. What is padded is less than GRID ids a sequence, and the end of each
group.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.tokens import default_path, encoder, texts_of
from gleaner.runtime import prepare, settle, table

CAPACITY, END_ID = 2048, 1
#: Cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n (a model of width d: about 12 d to 1).
LINEAR, QUADRATIC = 12288.0, 1.0
#: Pieces of a group, about, and the ids between two places where a piece may be cut.
GROUP, GRID = 20_000, 16


class Room:
    """Sequences by free room; the lowest cost among those with enough room, in steps of the tree's depth."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(capacity + 1)]
        self.tree: list = [(float("inf"), -1)] * (2 * self.base)
        self.most = capacity

    def refresh(self, free: int) -> None:
        tree, i = self.tree, self.base + free
        tree[i] = self.heaps[free][0] if self.heaps[free] else (float("inf"), -1)
        i >>= 1
        while i:
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
            i >>= 1

    def put(self, free: int, cost: float, seq: int) -> None:
        heapq.heappush(self.heaps[free], (cost, seq))
        self.refresh(free)
        self.most = max(self.most, free)

    def widest(self) -> int:
        """The most room that a sequence has."""
        while self.most and not self.heaps[self.most]:
            self.most -= 1
        return self.most

    def take(self, need: int) -> tuple[float, int]:
        """The lowest-cost sequence with room for `need`; (inf, -1) if there is none."""
        tree, best, i, end = self.tree, (float("inf"), -1), self.base + need, 2 * self.base
        while i < end:
            if i & 1:
                best = min(best, tree[i])
                i += 1
            if end & 1:
                end -= 1
                best = min(best, tree[end])
            i >>= 1
            end >>= 1
        return best


def cost_of(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) of each part of the pieces."""
    waiting = [(-n, i, 0) for i, n in enumerate(lengths.tolist())]
    heapq.heapify(waiting)
    room, free, out = Room(capacity), [], []
    for s in range(-(-int(lengths.sum()) // capacity)):
        free.append(capacity)
        heapq.heappush(room.heaps[capacity], (0.0, s))
    room.refresh(capacity)
    while waiting:
        n, i, start = heapq.heappop(waiting)
        n = -n
        cost, s = room.take(n)
        if s < 0:
            fits = room.widest() // grid * grid
            if fits:
                heapq.heappush(waiting, (fits - n, i, start + fits))
                n = fits
                cost, s = room.take(n)
            else:
                cost, s = 0.0, len(free)
                free.append(capacity)
                room.put(capacity, cost, s)
        heapq.heappop(room.heaps[free[s]])
        room.refresh(free[s])
        out.append((i, start, n, s, capacity - free[s]))
        free[s] -= n
        room.put(free[s], cost + cost_of(n), s)
    return out


def joined(first: int, second: int, size: int) -> int:
    """The checksum of two parts in a row, of theirs and the bytes of the second one."""
    zeros = bytes(size)
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def cutter(path: str, capacity: int, end_id: int, grid: int):
    """From (doc_id, text) to a row for each piece; parts has the checksum of every `grid` ids of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids, counts = encoder(path).encode(texts_of(some.column(1)))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, counts[row] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = (np.cumsum(counts) - counts)[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                parts = [np.array([zlib.crc32(raw[4 * x : 4 * min(x + grid, a + n)]) for x in range(a, a + n, grid)], "<u4").tobytes() for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(counts[row], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, grid: int = GRID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, the end id alone. Rows of equal or null doc_id are documents of their own. A
    document of any length is cut into pieces of at most `capacity`. An empty table gives no rows. Extra columns
    aren't read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = settle(docs.select("doc_id", "text").mapInArrow(cutter(path or default_path(), capacity, end_id, grid), f"{schema}, parts binary"), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("tie")
        placed = assign(table.column("length").to_numpy(), capacity, grid)
        piece, start, length, seq, offset = np.array(placed, np.int64).T
        parts, whole = table.column("parts").to_pylist(), table.column("length").to_numpy()
        crc = table.column("ids_crc32").to_numpy()[piece]
        for k in np.flatnonzero(length < whole[piece]).tolist():
            sums, a, n, total = np.frombuffer(parts[piece[k]], "<u4").tolist(), int(start[k]), int(length[k]), 0
            for x in range(a, a + n, grid):
                total = joined(total, sums[x // grid], 4 * min(grid, a + n - x))
            crc[k] = total
        own = table.take(pa.array(piece))
        group_id = own.column("group").to_numpy()
        return pa.table({"doc_id": own.column("doc_id"), "start": own.column("start").to_numpy() + start, "length": length, "ids_crc32": crc, "doc_tokens": own.column("doc_tokens"), "sequence_id": (group_id << 32) + seq, "offset": offset})

    dealt = pieces.withColumn("tie", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("tie"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInArrow(packed, f"{schema}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
