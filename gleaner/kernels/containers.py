"""Containers: archives, PDF, audio and video tags, fonts, WebAssembly."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

from gleaner.kernels.inflate import GZIP, ZLIB, inflate

#: Containers within containers that are opened: the first and three below it.
LEVELS = 4

# What a name record is about; boxes with text, and boxes with boxes.
NAMES = {
    0: "copyright", 1: "font family", 2: "font subfamily", 3: "unique id", 4: "full name", 5: "version", 6: "postscript name",
    7: "trademark", 8: "manufacturer", 9: "designer", 10: "description", 11: "vendor url", 12: "designer url", 13: "license",
    14: "license url", 19: "sample text",
}
TEXT_BOXES = frozenset(("udta", "meta", "ilst", "data", "©nam", "©cmt", "©too", "desc", "name"))
OUTER_BOXES = frozenset(("moov", "udta", "meta", "ilst", "trak", "mdia", "minf", "stbl"))
BOX_DEPTH = 6


def kind_of(body: bytes) -> str | None:
    if body[:4] == b"PK\x03\x04":
        return "zip"
    if body[:2] == b"\x1f\x8b":
        return "gzip"
    return "tar" if len(body) > 262 and body[257:262] == b"ustar" else None


def tar_members(body: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at + 512 <= len(body):
        name = body[at : at + 100].split(b"\0")[0].decode("latin-1")
        digits = re.match(rb"\s*([0-7]+)", body[at + 124 : at + 136].split(b"\0")[0])
        if not name or not digits:
            return
        n = int(digits[1], 8)
        if at + 512 + n > len(body):
            return
        yield name, body[at + 512 : at + 512 + n]
        at += 512 + -(-n // 512) * 512


def zip_members(body: bytes) -> list[tuple[str, bytes]]:
    """All members, or none if any can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist()]
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, OSError, EOFError, struct.error):
        return []


def members(body: bytes, prefix: str = "", level: int = 0) -> Iterator[tuple[str, str, bytes]]:
    """(container, path, content) of each member, and of members of members, depth first."""
    kind = kind_of(body) if level < LEVELS else None
    if kind == "gzip":
        content = inflate(body, GZIP)
        found = [] if content is None else [("<gunzipped>", content)]
    else:
        found = zip_members(body) if kind == "zip" else tar_members(body) if kind == "tar" else []
    for name, content in found:
        path = f"{prefix}!{name}" if prefix else name
        yield kind, path, content
        yield from members(content, path, level + 1)


STREAM = re.compile(rb"stream\r?\n?(.*?)endstream", re.DOTALL)
STRING = r"\(((?:\\.|[^\\()])*)\)"
SHOWN, SHOWN_ARRAY = re.compile(STRING + r"\s*(?:Tj|TJ|'|\")"), re.compile(r"\[((?:[^\][]|\\.)*)\]\s*TJ")
PART, HEX_STRING = re.compile(STRING), re.compile(r"<([0-9a-fA-F\s]{20,})>")


def pdf_streams(body: bytes) -> Iterator[str]:
    for m in STREAM.finditer(body):
        found = inflate(m[1], ZLIB)
        if found is not None:
            yield found.decode("latin-1")


def pdf_unescape(text: str) -> str:
    text = re.sub(r"\\([0-7]{1,3})", lambda m: chr(int(m[1], 8)), text)
    for name, c in (("n", "\n"), ("r", "\r"), ("t", "\t")):
        text = text.replace("\\" + name, c)
    return re.sub(r"\\([()\\])", r"\1", text)


def pdf_shown(content: str) -> str:
    """Arguments of the operators that show text, a line each; those of an array one by one and joined."""
    lines = [pdf_unescape(m[1]) for m in SHOWN.finditer(content)]
    for m in SHOWN_ARRAY.finditer(content):
        parts = [pdf_unescape(x) for x in PART.findall(m[1])]
        lines += [*parts, "".join(parts)]
    return "\n".join(lines)


def pdf_hex_strings(raw: str) -> Iterator[str]:
    for m in HEX_STRING.finditer(raw):
        digits = re.sub(r"\s+", "", m[1])
        if len(digits) % 2 == 0:
            yield bytes.fromhex(digits).decode("latin-1")


INFO = re.compile(r"/(Title|Author|Subject|Keywords|Creator|Producer)\s*" + STRING)


def pdf_info(raw: str) -> str:
    """Entries of the document's information dictionary that are plain strings."""
    return "\n".join(f"{m[1]}: {pdf_unescape(m[2])}" for m in INFO.finditer(raw))


def id3_text(payload: bytes) -> str:
    coding, data = payload[:1], payload[1:]
    if coding == b"\x01" or (coding == b"\x02" and len(data) % 2):
        return data[: len(data) // 2 * 2].decode("utf-16-le", "replace")
    return data.decode({b"\x02": "utf-16-be", b"\x03": "utf-8"}.get(coding, "latin-1"), "replace")


def id3_frames(body: bytes) -> Iterator[tuple[str, str]]:
    """Frames of the tag at the start, sizes as plain numbers, and the old tag at the end."""
    if body[:3] == b"ID3" and len(body) > 10:
        total = 0
        for b in body[6:10]:
            total = total << 7 | b
        at, end = 10, min(10 + total, len(body))
        while at + 10 <= end and re.fullmatch(rb"[A-Z0-9]{4}", body[at : at + 4]):
            size = int.from_bytes(body[at + 4 : at + 8], "big")
            if size == 0 or at + 10 + size > end:
                break
            yield body[at : at + 4].decode(), id3_text(body[at + 10 : at + 10 + size])
            at += 10 + size
    if len(body) >= 128 and body[-128:-125] == b"TAG":
        yield "ID3v1", body[-128:].decode("latin-1")


def boxes(body: bytes) -> Iterator[tuple[str, str]]:
    """Boxes of an MP4 file that hold text."""

    def walk(at: int, end: int, depth: int) -> Iterator[tuple[str, str]]:
        while depth <= BOX_DEPTH and at + 8 <= end:
            size, kind = int.from_bytes(body[at : at + 4], "big"), body[at + 4 : at + 8].decode("latin-1")
            if size < 8 or at + size > end:
                return
            if kind in TEXT_BOXES:
                yield kind, re.sub("\0+", " ", body[at + 8 : at + size].decode("utf-8", "replace"))
            if kind in OUTER_BOXES:
                yield from walk(at + (12 if kind == "meta" else 8), at + size, depth + 1)
            at += size

    if len(body) > 12 and body[4:8] in (b"ftyp", b"moov", b"mdat"):
        yield from walk(0, len(body), 0)


def name_tables(body: bytes) -> Iterator[bytes]:
    """Name tables of an OpenType font, or of one wrapped in WOFF."""
    if body[:4] == b"wOFF":
        count, first, step, fields = struct.unpack_from(">H", body, 12)[0], 44, 20, ">4sIII"
    else:
        count, first, step, fields = struct.unpack_from(">H", body, 4)[0], 12, 16, ">4s4xII"
        if not 0 < count <= 512:
            return
    for i in range(count):
        if first + (i + 1) * step > len(body):
            return
        tag, at, size, *full = struct.unpack_from(fields, body, first + i * step)
        if tag != b"name" or at + size > len(body):
            continue
        data = body[at : at + size]
        data = inflate(data, ZLIB) if full and full[0] != size else data
        if data is not None and len(data) >= 6:
            yield data
        if full:
            return  # only the first table of a wrapped font


def name_records(body: bytes) -> Iterator[tuple[int, str]]:
    for t in name_tables(body):
        count, strings = struct.unpack_from(">HH", t, 2)
        for at in range(6, 6 + 12 * count, 12):
            if at + 12 > len(t):
                break
            platform, _, _, name, size, offset = struct.unpack_from(">6H", t, at)
            raw = t[strings + offset : strings + offset + size]
            if len(raw) == size:
                yield name, raw.decode("latin-1" if platform == 1 or size % 2 else "utf-16-be", "replace")


def varuint(data: bytes, at: int) -> tuple[int, int] | None:
    """(value, place after it) of an unsigned LEB128 number of at most five bytes."""
    value = 0
    for i in range(5):
        if at + i >= len(data):
            return None
        value |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            return value & 0xFFFFFFFF, at + i + 1
    return None


def wasm_sections(body: bytes) -> Iterator[tuple[int, str | None, bytes]]:
    """(id, name of a custom section, content)."""
    at = 8
    while body[:4] == b"\0asm" and at < len(body):
        head = varuint(body, at + 1)
        if head is None or head[1] + head[0] > len(body):
            return
        payload = body[head[1] : head[1] + head[0]]
        name = varuint(payload, 0) if body[at] == 0 else None
        yield body[at], payload[name[1] : name[1] + name[0]].decode("utf-8", "replace") if name else None, payload
        at = head[1] + head[0]
