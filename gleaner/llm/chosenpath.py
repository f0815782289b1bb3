"""Near-duplicate documents by a chosen-path set similarity join over 5-word shingles.

Documents of equal sets go on as one vertex. A vertex has 16 minwise tokens, the roots of 16 trees, and a sketch of 256
bytes of which every tree has 15 to itself. A node of a tree holds the vertices that agree on all tokens of its path:

1. A node of more than NODE members branches in Spark. It draws one member as its lead; those close to the lead stay
   behind with it, and the others branch on one or two coordinates that the node draws (4/3 on average, 1 / 0.75: a pair
   of similarity s has s / 0.75 common children a level, so what is below 0.75 dies out and links hold on).
2. Smaller nodes go to a task, where they branch on until they hold some tens, which are compared exhaustively. A node
   whose members are on average too alike for branching to part them is compared with a few of its members, and what
   isn't connected with them with all the others.
3. Comparing goes by sketches, with a margin, and gives no pairs: each task reports forests, a row for each vertex and
   node at most. Their components (groups) hold every link that a tree has found, and some vertices too many.
4. Every group meets with the full shingle sets of its vertices, which decide. In a group that is too large for one task
   all vertices are held against some of them; those outside the largest part then meet the others and each other, block
   by block (their number counts twice there; the others' only once).

So a group of copies costs rows in proportion to its members, and whatever links the sketches suggest are confirmed.
A link is only lost if all 16 trees lose it. At similarity 0.75 a tree loses it with probability 0.25 at the root, and
0.55 if three more levels follow; see README for measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.arrays import BASE1, BASE2, SPACED, SpanHash, U, Words, chunks, grams, mix, ranges
from gleaner.llm.repeats import splittable
from gleaner.runtime import discard, prepare, settle, table

SHINGLE, PERCENT = 5, 75
#: Trees, minwise functions of which a sketch has one byte each, and the sketch bytes that a tree has to itself.
TREES, SKETCH = 16, 256
OWN = (SKETCH - TREES) // TREES
#: Members up to which a node goes to one task, and up to which it is compared exhaustively there.
NODE, LEAF = 4096, 48
#: Members of nodes, and shingles of groups, that a task takes at a time, about; a block has half as many shingles.
BUCKET, ITEMS = 8192, 1 << 20
#: Equal sketch bytes of 256 from which a pair is worth confirming (a pair of similarity 0.75 has fewer once in 1e7), from
#: which it is so for the lead of a large node, and from which a member stays behind with the lead: whatever is linked
#: with such a member has similarity 0.5 or so to the lead, and joins the lead's group by the second number.
AGREE, LOOSE, CLOSE = 156, 116, 204
#: Members that a node or a large group is held against, and the mean similarity from which a node counts as dense.
PIVOTS, DENSE = 4, 0.45
#: Levels of a path that use a tree's own bytes; beyond them all bytes serve.
DEEP = 12

MULTIPLIERS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * BASE1) | U(1)
SHIFTS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * BASE2)


# Sets and signatures ---------------------------------------------------------------------------------------------


def sets_of(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, distinct shingle hashes of the documents end to end, their bounds) of each chunk."""
    for lo, hi, data, offsets in chunks(texts):
        w = Words(data, offsets, SPACED, True)
        g = grams(w.hash, k)
        whole = SpanHash(w.hash)
        out = []
        for a, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
            if n >= k:
                out.append(np.unique(g[a : a + n - k + 1]))
            else:
                out.append(whole(np.array([a]), np.array([a + n])) if n else np.zeros(0, np.uint64))
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in out])))
        yield lo, hi, np.concatenate(out), bounds


def digests(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set; zeros for an empty one."""
    full = np.flatnonzero(np.diff(bounds))
    d = np.zeros((2, len(bounds) - 1), np.int64)
    if len(full):
        for k, b in enumerate((BASE1, BASE2)):
            d[k, full] = np.add.reduceat(mix(flat + b), bounds[:-1][full]).view(np.int64)
    return d


def binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Back from binary(): a row of `width` values for each binary value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    size = width * np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], np.uint8)[column.offset * size :][: len(column) * size].view(kind).reshape(-1, width)


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, doc_id, text) to (key, doc_id, n, d1, d2, tokens, sketch)."""
    for batch in batches:
        for lo, hi, flat, bounds in sets_of(batch.column(2)):
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            sig, sketch = np.zeros((hi - lo, TREES), np.uint32), np.zeros((hi - lo, SKETCH), np.uint8)
            if len(full):
                start = bounds[:-1][full]
                for j in range(SKETCH):
                    least = np.minimum.reduceat((flat * MULTIPLIERS[j] + SHIFTS[j]) >> U(32), start)
                    sketch[full, j] = least & U(255)
                    if j < TREES:
                        sig[full, j] = least
            d = digests(flat, bounds)
            own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(d[0]), pa.array(d[1]), binary(sig), binary(sketch)], names=["key", "doc_id", "n", "d1", "d2", "tokens", "sketch"])


# Trees -----------------------------------------------------------------------------------------------------------


def child(node: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(node ^ mix(token.astype(np.uint64) * BASE1 + coordinate.astype(np.uint64)))


def draws(node: np.ndarray, tree: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first coordinate of each node, its second one, and whether it uses that too (one node in three)."""
    deep = np.asarray(level) >= DEEP
    first, many = np.where(deep, TREES, TREES + tree * OWN), np.where(deep, SKETCH - TREES, OWN).astype(np.uint64)
    one = (mix(node) % many).astype(np.int64)
    two = (one + 1 + (mix(node ^ BASE2) % (many - U(1))).astype(np.int64)) % many.astype(np.int64)
    return first + one, first + two, mix(node ^ BASE1) % U(3) == 0


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (r, tokens) to TREES rows (node, r, tree)."""
    for batch in batches:
        sig = matrix(batch.column(1), np.uint32, TREES)
        n = len(sig)
        nodes = np.stack([child(np.full(n, j + 1, np.uint64), np.full(n, j), sig[:, j]) for j in range(TREES)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES))), pa.array(np.tile(np.arange(TREES, dtype=np.int32), n))], names=["node", "r", "tree"])


def branch(level: int):
    """From members (node, r, tree, sketch, n, lead, lead_sketch, lead_n) to rows (node, r, tree, lead): of members alike enough
    (lead, r), and of the children that a member goes on to if it doesn't stay behind (lead is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, tree = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            sketch, n = matrix(batch.column(3), np.uint8, SKETCH), batch.column(4).to_numpy()
            equal = np.count_nonzero(sketch == matrix(batch.column(6), np.uint8, SKETCH), axis=1)
            alike, row = np.flatnonzero(equal >= LOOSE), np.arange(len(node))
            one, two, both = draws(node, tree, level)
            go = equal < CLOSE
            rows = np.concatenate((alike, row[go], row[go & both]))
            nodes = np.concatenate((node[alike], child(node, one, sketch[row, one])[go], child(node, two, sketch[row, two])[go & both]))
            lead = pa.concat_arrays([batch.column(5).take(pa.array(alike)), pa.nulls(len(rows) - len(alike), pa.int64())])
            again = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column(1).take(again), batch.column(2).take(again), lead], names=["node", "r", "tree", "lead"])

    return run


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex that each of 0..n-1 is connected with by the edges (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class Nodes:
    """Nodes of some trees over the same vertices, branched and compared by sketches until their forests are known."""

    def __init__(self, sketch: np.ndarray, size: np.ndarray, percent: int):
        self.sketch, self.size, self.percent = sketch, size, percent
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.leaves: dict[int, list[np.ndarray]] = {}

    def fits(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        a, b = self.size[i], self.size[j]
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def add(self, members: np.ndarray, node: int, tree: int, leaf: int = LEAF) -> None:
        """One root node of this task."""
        open_ = [(members, node, 0)]
        while open_:
            own, at, level = open_.pop()
            if len(own) <= leaf:
                self.leaves.setdefault(len(own), []).append(own)
                continue
            equal = np.stack([np.count_nonzero(self.sketch[own] == self.sketch[own[k * len(own) // PIVOTS]], axis=1) for k in range(PIVOTS)])
            if (np.mean(equal) / SKETCH - 1 / 256) / (1 - 1 / 256) >= DENSE:
                self.dense(own, equal)
                continue
            here = np.array([at], np.uint64)
            one, two, both = draws(here, np.array([tree]), level)
            for c in (one, two) if both[0] else (one,):
                byte = self.sketch[own, c[0]]
                order = np.argsort(byte, kind="stable")
                edge = np.flatnonzero(np.diff(byte[order], prepend=-1, append=-1))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if b - a > 1:
                        open_.append((own[order[a:b]], int(child(here, c, byte[order[a : a + 1]])[0]), level + 1))

    def dense(self, own: np.ndarray, equal: np.ndarray) -> None:
        """Compares a node with its pivots, and with all members those that aren't connected with most others then."""
        m = len(own)
        pivots = np.arange(PIVOTS) * m // PIVOTS
        a, b = np.nonzero(equal >= AGREE)
        good = self.fits(own[pivots[a]], own[b])
        a, b = pivots[a[good]], b[good]
        label = connected(m, a, b)
        most = np.bincount(label).argmax()
        left, right = [a], [b]
        for y in np.flatnonzero(label != most).tolist():
            some = np.flatnonzero((np.count_nonzero(self.sketch[own] == self.sketch[own[y]], axis=1) >= AGREE) & self.fits(own[y], own))
            some = some[np.unique(label[some], return_index=True)[1]]  # one of each part is enough to connect them
            left.append(np.full(len(some), y))
            right.append(some)
        self.left.append(own[np.concatenate(left)])
        self.right.append(own[np.concatenate(right)])

    def forest(self, step: int = 1 << 14) -> np.ndarray:
        """Compares the leaves, and gives the smallest vertex that each one is connected with."""
        for k, nodes in self.leaves.items():
            grid = np.stack(nodes)
            i, j = np.triu_indices(k, 1)
            for at in range(0, len(grid), max(1, step // max(1, len(i)))):
                part = grid[at : at + max(1, step // max(1, len(i)))]
                a, b = part[:, i].ravel(), part[:, j].ravel()
                good = self.fits(a, b)
                a, b = a[good], b[good]
                good = np.count_nonzero(self.sketch[a] == self.sketch[b], axis=1) >= AGREE
                self.left.append(a[good])
                self.right.append(b[good])
        none = [np.zeros(0, np.int64)]
        return connected(len(self.size), np.concatenate(none + self.left), np.concatenate(none + self.right))


def compare(percent: int, leaf: int):
    """A bucket of whole nodes (node, r, tree, n, sketch) to its forest: (x, y) with y the vertices, x another of the same group."""

    def run(bucket: pa.Table) -> pa.Table:
        node, r, tree = (bucket.column(c).to_numpy() for c in ("node", "r", "tree"))
        vertices, first, which = np.unique(r, return_index=True, return_inverse=True)
        sketch = matrix(bucket.column("sketch"), np.uint8, SKETCH)[first]
        nodes = Nodes(sketch, bucket.column("n").to_numpy()[first], percent)
        order = np.argsort(node, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(node[order]) != 0, [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            at = order[a]
            nodes.add(which[order[a:b]], int(node[at : at + 1].view(np.uint64)[0]), int(tree[at]), leaf)
        label = nodes.forest()
        some = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"x": vertices[label[some]], "y": vertices[some]})

    return run


def forests(own: DataFrame, percent: int = PERCENT, node: int = NODE, leaf: int = LEAF) -> DataFrame:
    """Edges (x, y) between vertices of own(r, n, tokens, sketch); their components hold every link a tree has found."""
    members = own.select("r", "tokens").mapInArrow(roots, "node long, r long, tree int")
    edges, small, done, level = [], [], [], 0
    while True:
        sizes = members.groupBy("node").agg(F.count("*").alias("size"), F.min_by("r", F.xxhash64("r", "node")).alias("lead")).where("size > 1")
        both = settle(splittable(members, sizes, "node"), "members")
        done.append(both)
        small.append(both.where(F.col("size") <= node).select("node", "r", "tree"))
        large = both.where(F.col("size") > node)
        if large.isEmpty():
            break
        known = own.select("r", "n", "sketch")
        leads = large.select("node", "lead").distinct().join(known.toDF("lead", "lead_n", "lead_sketch"), "lead")
        wide = large.select("node", "r", "tree").join(known, "r").join(leads, "node")
        grown = settle(wide.select("node", "r", "tree", "sketch", "n", "lead", "lead_sketch", "lead_n").mapInArrow(branch(level), "node long, r long, tree int, lead long"), "grown")
        done.append(grown)
        edges.append(grown.where("lead <> r").select(F.col("lead").alias("x"), F.col("r").alias("y")))
        members, level = grown.where("lead is null").select("node", "r", "tree").distinct(), level + 1
    every = small[0]
    for s in small[1:]:
        every = every.unionByName(s)
    buckets = max(1, -(-every.count() // BUCKET))
    wide = every.join(own.select("r", "n", "sketch"), "r").withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    out = wide.groupBy("bucket").applyInArrow(compare(percent, leaf), "x long, y long")
    for e in edges:
        out = out.union(e)
    out = settle(out.distinct(), "forests")
    discard(*done)
    return out


# Components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame | None:
    """(v, c): the smallest vertex that each vertex of some edge is connected with; None without edges.

    Each round moves every vertex to its smallest neighbour's smallest neighbour and carries the edges over."""
    label, done = None, []
    for _ in range(rounds):
        edges = settle(edges.where("x <> y"), "edges")
        if edges.isEmpty():
            discard(edges, *done)
            return label
        near = settle(edges.union(edges.select("y", "x")).toDF("v", "u").groupBy("v").agg(F.least("v", F.min("u")).alias("p")), "near")
        far = settle(near.join(near.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p")), "far")
        discard(near, *done)
        done = [edges, far]
        if label is None:
            label = settle(far.select("v", F.col("p").alias("c")), "labels")
        else:
            before, label = label, settle(label.join(far.select(F.col("v").alias("c"), "p"), "c", "left").select("v", F.coalesce("p", "c").alias("c")), "labels")
            discard(before)
        edges = edges.join(far.toDF("x", "px"), "x").join(far.toDF("y", "py"), "y").select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct()
    raise RuntimeError("components didn't settle")


# Confirming on full sets -----------------------------------------------------------------------------------------


def wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, d1, d2, group, large, r) to (group, large, r, items), where the text's set has that digest."""
    for batch in batches:
        for lo, hi, flat, bounds in sets_of(batch.column(0)):
            d = digests(flat, bounds)
            own = batch.slice(lo, hi - lo)
            good = (d[0] == own.column(1).to_numpy()) & (d[1] == own.column(2).to_numpy())
            items = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*own.columns[3:], items], names=["group", "large", "r", "items"]).filter(pa.array(good))


def linked(flat: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Components (as smallest index) of sets under links of enough similarity, on full sets.

    A few sets are compared with all by the postings of their items; so is then every set outside the largest
    component. A link has an end outside it, or joins two sets that are connected already."""
    m, size = len(bounds) - 1, np.diff(bounds)
    _, item, count = np.unique(flat, return_inverse=True, return_counts=True)
    posting = np.repeat(np.arange(m), size)[np.argsort(item, kind="stable")]
    start = np.cumsum(count) - count
    left, right = [], []

    def against_all(x: int) -> None:
        own = item[bounds[x] : bounds[x + 1]]
        common = np.bincount(posting[ranges(start[own], count[own])], minlength=m)
        some = np.flatnonzero(100 * common >= percent * (size[x] + size - common))
        left.append(np.full(len(some), x))
        right.append(some)

    first = sorted({k * m // min(m, 8) for k in range(min(m, 8))})
    for x in first:
        against_all(x)
    label = connected(m, np.concatenate(left), np.concatenate(right))
    rest = label != np.bincount(label).argmax()
    rest[first] = False
    for x in np.flatnonzero(rest).tolist():
        against_all(x)
    return connected(m, np.concatenate(left), np.concatenate(right))


def decide(percent: int):
    """A bucket of whole groups or cells (group, r, items) to confirmed forests (x, y), y being linked with x by a chain."""

    def run(bucket: pa.Table) -> pa.Table:
        group, r = bucket.column("group").to_numpy(), bucket.column("r").to_numpy()
        items = bucket.column("items").combine_chunks()
        flat, size = items.flatten().to_numpy(), pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.lexsort((r, group))
        order = order[np.concatenate(([True], (np.diff(group[order]) != 0) | (np.diff(r[order]) != 0)))[: len(order)]]  # equal rows of a document
        edge = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0, [True]))) if len(order) else [0]
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = order[a:b]
            label = linked(flat[ranges(begin[own], size[own])], np.concatenate(([0], np.cumsum(size[own]))), percent)
            some = np.flatnonzero(label != np.arange(len(own)))
            x.append(r[own[label[some]]])
            y.append(r[own[some]])
        return pa.table({"x": np.concatenate(x), "y": np.concatenate(y)})

    return run


def against(percent: int):
    """From (r, items, pivots: array of (r, items)) to the edges (x, y) with the pivots that a set is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for row in range(batch.num_rows):
                r, own = batch.column(0)[row].as_py(), batch.column(1)[row].values.to_numpy()
                pivots = batch.column(2)[row].values
                for k in range(len(pivots)):
                    other = pivots.field(1)[k].values.to_numpy()
                    common = np.isin(own, other, assume_unique=True).sum()
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        x.append(pivots.field(0)[k].as_py())
                        y.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return run


def in_buckets(cells: DataFrame, total: int, percent: int, items: int) -> DataFrame:
    """Confirmed forests of whole cells (group, r, items), so many items in all."""
    buckets = max(1, -(-total // items))
    return cells.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets))).groupBy("bucket").applyInArrow(decide(percent), "x long, y long")


def in_blocks(sets: DataFrame, percent: int, items: int) -> DataFrame:
    """Confirmed edges (x, y) of groups (group, r, items) that are too large for one task."""
    chosen = sets.groupBy("group").agg(*(F.min_by("r", F.xxhash64("r", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS))).select("group", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("r"))
    pivots = sets.join(chosen, ["group", "r"]).dropDuplicates(["group", "r"]).groupBy("group").agg(F.collect_list(F.struct("r", "items")).alias("pivots"))
    first = settle(splittable(sets, pivots, "group").select("r", "items", "pivots").mapInArrow(against(percent), "x long, y long").distinct(), "pivots")
    label = components(first)
    vertices = sets.select("group", "r", F.size("items").cast("long").alias("n")).distinct()
    parts = vertices.withColumn("c", F.col("r")) if label is None else vertices.join(label.withColumnRenamed("v", "r"), "r", "left").withColumn("c", F.coalesce("c", "r"))
    parts = settle(parts, "parts")
    most = parts.groupBy("group", "c").agg(F.count("*").alias("k")).groupBy("group").agg(F.max(F.struct("k", "c")).alias("m")).select("group", F.col("m.c").alias("top"))
    parts = splittable(parts, most, "group").withColumn("rest", F.col("c") != F.col("top"))
    many = parts.groupBy("group").agg(*(F.ceil(F.coalesce(F.sum(F.when(F.col("rest") == r, F.col("n"))), F.lit(0)) / (items / 2)).cast("int").alias(name) for r, name in ((True, "rests"), (False, "tops"))))
    dealt = settle(splittable(parts, many.where("rests > 0"), "group"), "dealt")
    # cells: a block of the rest with one of the top (from above the others' numbers on), or with itself or another of the rest
    own = F.pmod(F.xxhash64("r"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("tops"))).cast("long")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1).cast("array<long>")
    cell = lambda a, b: a * F.lit(1 << 31) + b
    among = F.transform(upto("rests"), lambda j: cell(F.least(own, j), F.greatest(own, j)))
    with_tops = F.when(F.col("tops") > 0, F.transform(upto("tops"), lambda j: cell(own, j + F.col("rests")))).otherwise(F.array().cast("array<long>"))
    cells = F.when(F.col("rest"), F.concat(among, with_tops)).otherwise(F.transform(upto("rests"), lambda i: cell(i, own + F.col("rests"))))
    dealt = dealt.select("group", "r", "n", cells.alias("cells"))
    total = dealt.agg(F.sum(F.col("n") * F.size("cells"))).first()[0] or 0
    met = sets.join(dealt.drop("n"), ["group", "r"]).select(F.explode("cells").alias("cell"), "group", "r", "items").select(F.xxhash64("group", "cell").alias("group"), "r", "items")
    return first.unionByName(in_buckets(met, total, percent, items))


def confirm(groups: DataFrame, texts: DataFrame, own: DataFrame, percent: int = PERCENT, items: int = ITEMS) -> tuple[DataFrame, bool]:
    """Confirmed edges (x, y) within groups (v, c), and whether they are stars already: a component's smallest vertex
    with each other one."""
    vertices = groups.select(F.col("v").alias("r"), F.col("c").alias("group")).join(own.select("r", "key", "n", "d1", "d2"), "r")
    totals = vertices.groupBy("group").agg(F.sum("n").alias("total"))
    known = splittable(vertices, totals, "group").withColumn("large", F.col("total") > items)
    known = settle(known.select("key", "d1", "d2", "group", "large", "r", "n"), "wanted")
    total, large = known.agg(F.sum(F.when(~F.col("large"), F.col("n"))), F.max("large")).first()
    sets = texts.join(known.hint("merge"), "key").select("text", "d1", "d2", "group", "large", "r").mapInArrow(wanted_sets, "group long, large boolean, r long, items array<long>")
    if large:
        sets = settle(sets, "wanted-sets")
    out = in_buckets(sets.where("not large").select("group", "r", "items"), total or 0, percent, items)
    if large:
        out = out.unionByName(in_blocks(sets.where("large").select("group", "r", "items"), percent, items))
    out = settle(out, "links")
    discard(known, *([sets] if large else []))
    return out, not large


def keyed(docs: DataFrame) -> Column:
    """A number by which a row of docs is found again, together with its set's digest: the id, or of rows without one a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def classes(docs: DataFrame, percent: int = PERCENT, node: int = NODE, leaf: int = LEAF, items: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """Rows of docs as (r, key, doc_id, n, d1, d2), and (n, d1, d2, component_id, key, leads) of each distinct set that
    isn't empty: its component, the key of its first row, and whether it is the component's first set."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(keyed(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = texts.mapInArrow(signatures, "key long, doc_id long, n long, d1 long, d2 long, tokens binary, sketch binary")
    every = settle(every.withColumn("r", F.monotonically_increasing_id()), "signatures")
    same = every.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("r").alias("r"), F.min("doc_id").alias("least"))
    own = settle(every.join(same.select("r", "least"), "r"), "own")
    edges = forests(own, percent, node, leaf)
    groups = components(edges)
    label = None
    if groups is not None:
        links, stars = confirm(groups, texts, own, percent, items)
        label = links.select(F.col("y").alias("v"), F.col("x").alias("c")) if stars else components(links)
    discard(edges)
    at = own.select("r", "key", "n", "d1", "d2", "least").withColumn("order", F.coalesce("least", F.lit((1 << 63) - 1)))
    at = at.withColumn("c", F.col("r")) if label is None else at.join(label.withColumnRenamed("v", "r"), "r", "left").withColumn("c", F.coalesce("c", "r"))
    # a component's first set is that of its smallest id; of several with that id (or with none) that of the smallest row
    parts = at.groupBy("c", "order").agg(F.min("r").alias("lead"), F.min("least").alias("component_id")).groupBy("c").agg(F.min_by("lead", "order").alias("lead"), F.min("component_id").alias("component_id"))
    return every.drop("tokens", "sketch"), splittable(at, parts, "c").select("n", "d1", "d2", "component_id", F.coalesce("least", "key").alias("key"), (F.col("r") == F.col("lead")).alias("leads"))


def cluster(docs: DataFrame, percent: int = PERCENT, node: int = NODE, leaf: int = LEAF, items: int = ITEMS) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles, no links, a component of their own, and are kept. A row without an id is
    linked like any other, but gives no component its name: alone or among its like its component is null and it is
    kept, otherwise it has the component's id and isn't. Rows of equal doc_id have a row each, by their own sets; `kept`
    marks every row whose doc_id is its component's. An empty table gives no rows; extra columns aren't read.
    """
    every, known = classes(docs, percent, node, leaf, items)
    out = every.join(known.drop("key", "leads"), ["n", "d1", "d2"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def with_digests(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, flat, bounds in sets_of(batch.column(at)):
                d = digests(flat, bounds)
                more = [pa.array(np.diff(bounds), pa.int64()), pa.array(d[0]), pa.array(d[1])]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *more], names=[*batch.schema.names, "__n", "__d1", "__d2"])

    return run


def distinct(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, with exactly one row of each component: that of smallest id, those without an id last, any one
    of rows with equal id and set. All columns stay.

    Rows decide, not ids: of an id with several texts only those go that are copies. Null and empty texts all stay.
    An empty table gives no rows.
    """
    _, known = classes(docs, percent)
    leads = settle(known.where("leads").select(F.col("key").alias("__key"), F.col("n").alias("__n"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2")), "leads")
    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__key long", "__n long", "__d1 long", "__d2 long"])
    by = ["__key", "__n", "__d1", "__d2"]
    marked = docs.where(words).withColumn("__key", keyed(docs)).mapInArrow(with_digests(docs.columns.index("text")), schema)
    return marked.join(leads, by, "left_semi").dropDuplicates(by).select(docs.columns).unionByName(docs.where(~words))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


def plain(rows: list[tuple[int, str | None]], k: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """The same by brute force, for tests."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    top = {d: d for d, _ in rows}

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r(v, u) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.v, z.y FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) z ON r.u = z.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(u) AS c FROM r GROUP BY v) USING (doc_id)
"""
