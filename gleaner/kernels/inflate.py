"""Decompression wherever a stream may begin in a body."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa

#: Bytes from the start within which streams are looked for.
REACH = 4_000_000
GZIP, ZLIB, RAW = 31, 15, -15
HEADS = re.compile(rb"\x1f\x8b\x08|\x78(?=[\x01\x9c\xda\x5e])")


def inflate(data: bytes, window: int) -> bytes | None:
    """A whole stream; None if it is none or is cut short. gzip members in a row are joined; what follows is passed over."""
    out, rest = [], data
    while True:
        d = zlib.decompressobj(window)
        try:
            out.append(d.decompress(rest) + d.flush())
        except zlib.error:
            return b"".join(out) if out and window == GZIP and rest is not data else None
        if not d.eof:
            return None
        rest = d.unused_data
        if window != GZIP or rest[:2] != b"\x1f\x8b":
            return b"".join(out)


def brotli(data: bytes) -> bytes | None:
    try:
        # read() doesn't free its 256 KB when it fails, as it does on nearly every body; readinto() has nothing to free
        stream, part, out = pa.CompressedInputStream(pa.BufferReader(data), "brotli"), bytearray(1 << 16), bytearray()
        while n := stream.readinto(part):
            out += memoryview(part)[:n]
        return bytes(out)
    except (OSError, pa.ArrowInvalid):
        return None


def streams(body: bytes) -> Iterator[tuple[str, bytes]]:
    """(label, content) of everything that decompresses to something: the body as a whole in four ways, then gzip and
    zlib streams that begin later in it."""
    whole = (("gzip", inflate(body, GZIP)), ("zlib", inflate(body, ZLIB)), ("raw deflate", inflate(body, RAW)), ("brotli", brotli(body)))
    yield from ((name, found) for name, found in whole if found)
    for m in HEADS.finditer(body, 1):
        if m.start() >= min(len(body) - 2, REACH):
            break
        kind = "gzip" if m[0][0] == 0x1F else "zlib"
        if found := inflate(body[m.start() :], GZIP if kind == "gzip" else ZLIB):
            yield f"{kind} @ +{m.start()}", found
