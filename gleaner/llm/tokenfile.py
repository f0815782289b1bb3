"""Token files: patched frame-of-reference blocks with an index, written in doc_id order and read back.

File, little-endian: magic "PFR1"; u64 ids, u64 documents, u64 blocks; for each document i64 doc_id, u8 null flag and
u64 ids (three columns, one after the other); for each block u64 start of its bytes (from the first block's), u32
minimum, u8 width, u16 exceptions (four columns); then the blocks. A block holds BLOCK ids (the last one fewer, filled
up with its minimum): id - minimum in `width` bits each, most significant bit first; then the exceptions' positions
(u8) and their bits above the width (u32). The width is the given percentile of the widths that the block's ids need.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.tokens import default_path, encoder, texts_of
from gleaner.runtime import prepare, settle, shared_dir, table

MAGIC, BLOCK, PERCENTILE = b"PFR1", 128, 90
#: Ids of a file at least, unless its partition holds fewer.
FILE_IDS = 4 << 20
#: Blocks packed at once.
AT_ONCE = 2048


class Decoded(NamedTuple):
    doc_ids: np.ndarray
    nulls: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


def bit_width(x: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.frexp(x.astype(np.float64))[1]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each row packed into width bits a value."""
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(*values.shape, 4), axis=-1)[..., 32 - width :]
    return np.packbits(bits.reshape(len(values), -1), axis=-1)


def unpack(rows: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=-1).reshape(len(rows), BLOCK, width)
    full = np.zeros((len(rows), BLOCK, 32), np.uint8)
    full[..., 32 - width :] = bits
    return np.packbits(full, axis=-1).view(">u4").reshape(len(rows), BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(minimum, width, exceptions of each block, bytes of all blocks)."""
    n = -(-len(ids) // BLOCK)
    lows, widths, excs, out = [], [], [], []
    for at in range(0, n, AT_ONCE):
        part = ids[at * BLOCK : (at + AT_ONCE) * BLOCK]
        rows = -(-len(part) // BLOCK)
        x = np.full(rows * BLOCK, part[(rows - 1) * BLOCK :].min(), np.uint32)
        x[: len(part)] = part
        x = x.reshape(rows, BLOCK)
        low = x.min(axis=1)
        x = x - low[:, None]
        need = bit_width(x)
        width = np.sort(need, axis=1)[:, BLOCK * percentile // 100]
        over = need > width[:, None]
        exc = over.sum(axis=1)
        packed: list[bytes] = [b""] * rows
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            if w:
                masked = x[own] & np.uint32((1 << w) - 1) if w < 32 else x[own]
                for i, row in zip(own.tolist(), pack(masked, w), strict=True):
                    packed[i] = row.tobytes()
        for i in np.flatnonzero(exc).tolist():
            where = np.flatnonzero(over[i])
            packed[i] += where.astype(np.uint8).tobytes() + (x[i, where] >> np.uint32(width[i])).astype("<u4").tobytes()
        lows.append(low)
        widths.append(width.astype(np.uint8))
        excs.append(exc.astype("<u2"))
        out += packed
    starts = np.cumsum([0, *map(len, out)])[:-1].astype("<u8")
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return starts, join(lows, "<u4"), join(widths, np.uint8), join(excs, "<u2"), b"".join(out)


def encode_file(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    starts, low, width, exc, body = encode_blocks(ids, percentile)
    head = np.array([len(ids), len(doc_ids), len(starts)], "<u8")
    columns = [head, doc_ids.astype("<i8"), nulls.astype(np.uint8), counts.astype("<u8"), starts, low, width, exc]
    return MAGIC + b"".join(x.tobytes() for x in columns) + body


def decode_blocks(body: np.ndarray, starts: np.ndarray, low: np.ndarray, width: np.ndarray, exc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        every = np.flatnonzero(width == w)
        for k in range(0, len(every), AT_ONCE):
            own = every[k : k + AT_ONCE]
            size = BLOCK * w // 8
            if w:
                out[own] = unpack(body[starts[own].astype(np.int64)[:, None] + np.arange(size)], w)
            for i in own[exc[own] > 0].tolist():
                at, e = int(starts[i]) + size, int(exc[i])
                where = body[at : at + e]
                out[i, where] |= np.frombuffer(body[at + e : at + 5 * e].tobytes(), "<u4") << np.uint32(w)
    return (out + low[:, None].astype(np.uint32)).ravel()[:n]


def decode_file(raw: bytes) -> Decoded:
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    n, docs, blocks = (int(x) for x in np.frombuffer(raw, "<u8", 3, 4))
    at, columns = 28, []
    for kind, rows in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u2", blocks)):
        columns.append(np.frombuffer(raw, kind, rows, at))
        at += columns[-1].nbytes
    doc_ids, nulls, counts, starts, low, width, exc = columns
    return Decoded(doc_ids, nulls.astype(bool), counts.astype(np.int64), decode_blocks(np.frombuffer(raw, np.uint8, offset=at), starts, low, width, exc, n))


def writer(folder: str, path: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        part, files = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, total, files
            doc_ids, nulls, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{base}/part-{part:06d}-{files:05d}.pfor"
            temporary = f"{name}.{uuid.uuid4().hex}"  # a second attempt at the task writes the same bytes
            with store.open_output_stream(temporary) as f:
                f.write(encode_file(doc_ids, nulls, counts, ids))
            store.move(temporary, name)
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [files], "path": [name], "n_ids": [len(ids)], "n_docs": [len(doc_ids)]}, schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))
            held, total, files = [], 0, files + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, counts = encoder(path).encode(texts_of(some.column(1)))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                keys = some.column(0)
                held.append((keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), keys.is_null().to_numpy(zero_copy_only=False), counts + 1, ids))
                total += len(ids)
                if total >= file_ids:
                    yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every text (null: none), each document followed by end_id, in ascending doc_id order (nulls
    first, then by the text's hash among equal ids) to files of `folder`, a URI that every executor can write.

    Returns part, file, path, n_ids, n_docs and start (ids in all files before) of each file. An empty table gives no
    file. Extra columns aren't read.
    """
    prepare(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, order[0]).sortWithinPartitions(*order)
    files = settle(ranged.mapInArrow(writer(folder, path or default_path(), end_id, file_ids), "part int, file int, path string, n_ids long, n_docs long"), "files")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file of millions of ids
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    d = decode_file(f.read())
                ends = np.cumsum(d.counts)
                raw = memoryview(d.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), d.counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(d.doc_ids, pa.int64(), mask=d.nulls), pa.array(start + ends - d.counts, pa.int64()), pa.array(d.counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "start").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/gleaner-pfor-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), folder), folder)
