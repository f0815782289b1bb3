"""Media columns: GIF. Decodes LZW code streams, applies palettes, disposal and transparency, gives timed frames with
colour histograms; and stores any bytes losslessly as 8-bit samples of a GIF.

The query writes the media column, reads it back, and has its digests and features from the frames that are decoded then."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.runtime import prepare, settle, table

#: Samples in a row of a stored payload, and the rows of a frame at most.
ROW, ROWS = 64, 65535
TABLE = 4096
LEVELS, BITS = 4, 6  # of each colour in a histogram; bits of a colour below its level


class Frame(NamedTuple):
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height of what the frame changes
    pixels: np.ndarray  # the whole screen after it: height x width x RGBA
    indexes: np.ndarray  # samples of the box, before the palette


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """A GIF code stream: variable widths from bits + 1 to 12, starting afresh whenever the table is full."""
    clear, most = 1 << bits, TABLE - (1 << bits) - 2
    codes: list[int] = [clear]
    emit, grow = codes.append, clear + 2
    known: dict[int, int] = {}
    get = known.get
    if data:
        code, fresh, end = data[0], grow, grow + most
        for byte in data[1:]:
            key = code << 8 | byte
            longer = get(key)
            if longer is not None:
                code = longer
            else:
                emit(code)
                code = byte
                known[key] = fresh
                fresh += 1
                if fresh == end:
                    emit(clear)
                    known.clear()
                    fresh = grow
        emit(code)
    emit(clear + 1)
    every = np.array(codes, np.int64)
    since = np.arange(len(every)) - np.maximum.accumulate(np.where(every == clear, np.arange(len(every)), 0)) - 1
    # a clear code itself is read at the width that the codes before it have reached
    since[every == clear] = np.concatenate(([-1], since[:-1]))[every == clear] + 1
    since[0] = 0
    width = widths(since, bits)
    grid = (every[:, None] >> np.arange(12)) & 1
    return np.packbits(grid[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def widths(since: np.ndarray, bits: int) -> np.ndarray:
    """Width of the code that is read after `since` others since the last clear code."""
    slots = (1 << bits) + 2 + np.maximum(since - 1, 0)  # entries of the reader's table
    return np.minimum(12, bits + 1 + sum((slots >= 1 << w).astype(np.int64) for w in range(bits + 1, 12)))


_widths: dict[int, np.ndarray] = {}


def first_widths(bits: int) -> np.ndarray:
    """widths() of the first TABLE codes."""
    if bits not in _widths:
        _widths[bits] = widths(np.arange(TABLE), bits)
    return _widths[bits]


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """The first `size` samples of a code stream (fewer if it ends before). A code that no table has yet is a ValueError."""
    clear = 1 << bits
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, at, since, out, got = 8 * len(stream), 0, 0, [], 0
    table: list[bytes] = [bytes([i]) for i in range(clear)] + [b"", b""]
    add, put, last = table.append, out.append, b""
    while at < total and got < size:
        most = min(TABLE, (total - at) // (bits + 1) + 1)
        width = first_widths(bits)[:most] if not since else widths(since + np.arange(most), bits)
        begin = at + np.cumsum(width) - width
        fits = int(np.searchsorted(begin + width, total, "right"))
        if not fits:
            break
        begin, width = begin[:fits], width[:fits]
        byte = begin >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else len(codes)
        known, before = len(table), len(out)
        for code in codes[:n].tolist():
            if code < known:
                now = table[code]
            elif code == known and last:
                now = last + last[:1]
            else:
                raise ValueError("a code beyond the table")
            if last and known < TABLE:
                add(last + now[:1])
                known += 1
            put(now)
            last = now
        got += sum(map(len, out[before:]))
        if not len(stops):
            at, since = int(begin[-1] + width[-1]), since + n
            continue
        if codes[n] == clear + 1:
            break
        at, since, last = int(begin[n] + width[n]), 0, b""
        del table[clear + 2 :]
    return b"".join(out)[:size]


def blocks(data: bytes) -> bytes:
    """Cut into sub-blocks of at most 255 bytes, and the empty one at the end."""
    whole = len(data) // 255
    body = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return np.concatenate((np.full((whole, 1), 255, np.uint8), body), axis=1).tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_bytes(payload: bytes) -> bytes:
    """A GIF whose samples are the payload (a multiple of 64 bytes): 64 to a row, a palette of greys, a frame for each
    65,535 rows."""
    rows = len(payload) // ROW
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, ROWS), 0xF7, 0, 0), grey]
    for top in range(0, rows, ROWS):
        high = min(ROWS, rows - top)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 0x04, 10, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, ROW, high, 0), b"\x08"]
        out.append(blocks(lzw_encode(payload[top * ROW : (top + high) * ROW])))
    return b"".join([*out, b"\x3b"])


def sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while raw[at]:
        parts.append(raw[at + 1 : at + 1 + raw[at]])
        at += raw[at] + 1
    return b"".join(parts), at + 1


def decode(raw: bytes) -> Iterator[Frame]:
    """Frames of a GIF in order. Raises ValueError if it is none, ends in the middle (or one of its code streams does), or
    uses a code before it is there."""
    try:
        yield from _decode(raw)
    except (IndexError, struct.error) as e:
        raise ValueError("broken GIF") from e


def _decode(raw: bytes) -> Iterator[Frame]:
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    screen = np.zeros((high, wide, 4), np.uint8)
    delay, clear_to, hole = 0, 0, None
    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            body, to = sub_blocks(raw, at + 2)
            if raw[at + 1] == 0xF9:
                bits, hundredths, index = struct.unpack_from("<BHB", body)
                delay, clear_to, hole = 10 * hundredths, bits >> 2 & 7, index if bits & 1 else None
            at = to
            continue
        if raw[at] != 0x2C:
            raise ValueError("broken GIF")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
        at, palette = at + 10, shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        if palette is None:
            raise ValueError("no palette")
        bits = raw[at]
        stream, at = sub_blocks(raw, at + 1)
        samples = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
        if len(samples) < w * h:
            raise ValueError("a code stream that ends early")
        samples = samples.reshape(h, w)
        if flags & 0x40:  # interlaced: rows 0, 8, .. then 4, 12, .. then 2, 6, .. then 1, 3, ..
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(samples)
            straight[rows] = samples
            samples = straight
        before = screen.copy() if clear_to == 3 else None
        part = screen[top : top + h, left : left + w]
        seen = samples[: part.shape[0], : part.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(palette), :3], colours[:, 3] = palette, 255
        if hole is None:
            part[:] = colours[seen]
        else:
            solid = seen != hole
            part[solid] = colours[seen[solid]]
        yield Frame(delay, (left, top, w, h), screen.copy(), samples)
        if clear_to == 2:
            part[:] = 0
        elif before is not None:
            screen = before
        delay, clear_to, hole = 0, 0, None


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels in LEVELS ** 3 cells of red, green and blue."""
    flat = pixels.reshape(-1, 4) >> BITS
    cell = flat[:, 0] << 4 | flat[:, 1] << 2 | flat[:, 2]
    return np.bincount(cell if flat[:, 3].all() else cell[pixels.reshape(-1, 4)[:, 3] > 0], minlength=LEVELS**3)


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each frame of each GIF: key, frame, delay_ms, width, height, rgba, histogram (64 counts), error.

    A null medium gives no rows; one that isn't a whole GIF gives the frames before the fault and a row with the error.
    Rows of null or equal key stay apart only by their order; extra columns aren't read.
    """
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(1)):
                own, n = batch.column(0).slice(i, 1), 0
                if raw.is_valid:
                    row: list = []
                    try:
                        for f in decode(raw.as_py()):
                            yield _row(own, [n, f.delay_ms, f.pixels.shape[1], f.pixels.shape[0], f.pixels.tobytes(), histogram(f.pixels).tolist(), None])
                            n += 1
                    except ValueError as e:
                        row = [n, None, None, None, None, None, str(e)]
                    if row:
                        yield _row(own, row)

    return media.select(key, column).mapInArrow(run, f"{key} {media.schema[key].dataType.simpleString()}, frame int, delay_ms int, width int, height int, rgba binary, histogram array<long>, error string")


def _row(key: pa.Array, values: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
    return pa.RecordBatch.from_arrays([key, *(pa.array([v], k) for v, k in zip(values, kinds, strict=True))], names=["key", "frame", "delay_ms", "width", "height", "rgba", "histogram", "error"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 (null: empty), filled up with zeros to a positive multiple of 64, as a GIF."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts = [t.encode() for t in pc.fill_null(some.column(1), "").to_pylist()]
                media = [encode_bytes(t + bytes(-len(t) % ROW or ROW * (not t))) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


FRAME = pa.struct([("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
DESCRIBED = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.list_(FRAME)), ("error", pa.string())]


def described(raw: bytes | None) -> tuple:
    """DESCRIBED of one medium."""
    if raw is None:
        return (None,) * len(DESCRIBED)
    payload, found = [], []
    try:
        for f in decode(raw):
            left, top, w, h = f.box
            seen = f.pixels[top : top + h, left : left + w]
            payload.append(np.ascontiguousarray(seen[..., 0]).tobytes())
            found.append(dict(zip(FRAME.names, (f.delay_ms, *f.box, histogram(seen).tolist()), strict=True)))
    except ValueError as e:
        return None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), found, str(e)
    body = b"".join(payload)
    return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-ROW:]), len(raw), hashlib.sha256(raw).hexdigest(), found, None


def describe(media: DataFrame) -> DataFrame:
    """From store()'s rows: the payload as it is read back through the palette, its digests, and the timed frames with the
    histograms (64 counts) of what each one shows.

    A null medium has null in all of these; one that isn't a whole GIF has no payload, the frames before the fault, and
    the error. An empty table gives no rows; rows of null or equal doc_id are described each."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                columns = zip(*(described(raw.as_py()) for raw in some.column(2)), strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(c, k) for c, (_, k) in zip(columns, DESCRIBED, strict=True))], names=["doc_id", "n_bytes", *(n for n, _ in DESCRIBED)])

    frame = "struct<delay_ms:int,left:int,top:int,width:int,height:int,histogram:array<long>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<{frame}>, error string")


def feature() -> Column:
    """Of described frames: how many, their time and rows, and the counts of the colours that occur (cell=count), all added up."""
    total = lambda name: F.aggregate("frames", F.lit(0), lambda n, f: n + f[name]).cast("string")
    cells = F.transform(F.sequence(F.lit(0), F.lit(LEVELS**3 - 1)), lambda c: F.struct(c.alias("cell"), F.aggregate("frames", F.lit(0).cast("long"), lambda n, f: n + F.get(f["histogram"], c)).alias("n")))
    shown = F.transform(F.filter(cells, lambda c: c["n"] > 0), lambda c: F.concat(c["cell"].cast("string"), F.lit("="), c["n"].cast("string")))
    return F.concat(F.lit("frames="), F.size("frames").cast("string"), F.lit(";ms="), total("delay_ms"), F.lit(";rows="), total("height"), F.lit(";"), F.array_join(shown, ","))


def payload_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of query(): the payload that is read back."""
    return query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = settle(store(table(spark, sf_dir, "documents")), "media")
    out = describe(media)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature().alias("feature"))


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, len(h) // 2 AS n, h || repeat('00', CASE WHEN h = '' THEN {ROW} ELSE ({ROW} - (len(h) // 2) % {ROW}) % {ROW} END) AS body FROM d)
SELECT doc_id, n AS n_bytes, len(body) // 2 AS payload_bytes, sha256(unhex(body)) AS payload_sha256 FROM p
"""
