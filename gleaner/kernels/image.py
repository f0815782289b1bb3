"""Images: text chunks, comments, metadata, bytes after the end, size. Readers stop at the first thing that is broken."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

from gleaner.functions.decode import entities
from gleaner.kernels.inflate import ZLIB, inflate

PNG = b"\x89PNG"
#: Bytes of an XMP packet that has no end.
XMP_MOST = 65_536

# Names of the metadata tags that hold text, by number.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "ModifyDate", 0x013B: "Artist",
    0x013C: "HostComputer", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x927C: "makerNote",
    0x9286: "userComment", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject",
    0xA420: "ImageUniqueID", 0xA430: "OwnerName", 0xA431: "SerialNumber", 0xA433: "LensMake", 0xA434: "LensModel",
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NUMBERS = {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d"}
IPTC = {5: "ObjectName", 25: "Keywords", 40: "SpecialInstructions", 80: "Byline", 105: "Headline", 110: "Credit", 115: "Source", 116: "CopyrightNotice", 120: "Caption", 122: "Writer"}


class Chunk(NamedTuple):
    kind: str
    keyword: str
    value: str


def text_of(data: bytes | None) -> str:
    return "" if data is None else data.decode("utf-8", "replace")


def png_chunks(body: bytes) -> Iterator[tuple[str, bytes]]:
    at = 8
    while body[:4] == PNG and at + 8 <= len(body):
        size = int.from_bytes(body[at : at + 4], "big")
        kind, end = body[at + 4 : at + 8].decode("latin-1"), at + 8 + size
        if end > len(body):
            return
        yield kind, body[at + 8 : end]
        if kind == "IEND":
            return
        at = end + 4


def png_texts(body: bytes) -> Iterator[Chunk]:
    for kind, data in png_chunks(body):
        if kind not in ("tEXt", "zTXt", "iTXt"):
            continue
        keyword, zero, rest = data.partition(b"\0")
        if not zero:
            keyword, rest = b"", data
        if kind == "tEXt":
            value = rest.decode("latin-1")
        elif kind == "zTXt":
            value = text_of(inflate(rest[1:], ZLIB))
        else:
            payload = rest[2:].split(b"\0", 2)[-1]  # after language and translated keyword
            value = text_of(inflate(payload, ZLIB) if rest[:1] == b"\x01" else payload)
        yield Chunk(kind, keyword.decode("latin-1"), value)


def jpeg_segments(body: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, place, payload) of each segment before the scan."""
    at = 2
    while body[:2] == b"\xff\xd8" and at + 4 <= len(body):
        marker = body[at + 1]
        if body[at] != 0xFF:
            at += 1
        elif marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
        elif marker in (0xDA, 0xD9):
            return
        else:
            size = int.from_bytes(body[at + 2 : at + 4], "big")
            yield marker, at, body[at + 4 : at + 2 + size]
            at += 2 + size


def jpeg_texts(body: bytes) -> Iterator[str]:
    """Comments as UTF-8, application segments as Latin-1."""
    for marker, _, data in jpeg_segments(body):
        if marker == 0xFE:
            yield text_of(data)
        elif 0xE0 <= marker <= 0xEF:
            yield data.decode("latin-1")


def gif_comments(body: bytes) -> Iterator[str]:
    """Every comment extension, wherever its two first bytes occur."""
    at = body.find(b"\x21\xfe") if body[:3] == b"GIF" else -1
    while at >= 0:
        text, cursor = b"", at + 2
        while cursor < len(body) and body[cursor]:
            text += body[cursor + 1 : cursor + 1 + body[cursor]]
            cursor += 1 + body[cursor]
        if text:
            yield text.decode("latin-1")
        at = body.find(b"\x21\xfe", at + 1)


def after_end(body: bytes) -> tuple[str, bytes] | None:
    """(end marker, bytes after it); the PNG end is looked for in a file of any kind."""
    for name, mark, skip, fits in (("PNG IEND", b"IEND", 8, True), ("JPEG EOI", b"\xff\xd9", 2, body[:2] == b"\xff\xd8"), ("GIF trailer", b"\x3b", 1, body[:3] == b"GIF")):
        at = body.rfind(mark) if fits else -1
        if at >= 0 or (fits and name != "PNG IEND"):
            return (name, body[at + skip :]) if 0 <= at and at + skip < len(body) else None
    return None


def tiff_tags(data: bytes) -> Iterator[tuple[str, object]]:
    """Tags of a TIFF structure, sub-directories included, as bytes, text or numbers."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return
    todo, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        for i in range(count):
            entry = at + 2 + 12 * i
            if entry + 12 > len(data):
                return
            tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
            size = SIZES.get(kind, 0) * n
            where = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            raw = data[where : where + size]
            if tag in (0x8769, 0x8825, 0xA005):
                todo.append(struct.unpack_from(order + "I", data, entry + 8)[0])
            elif kind == 2:
                yield TAGS.get(tag, str(tag)), raw.rstrip(b"\0").decode("utf-8", "replace")
            elif kind in (1, 7):
                yield TAGS.get(tag, str(tag)), raw
            elif kind in NUMBERS and len(raw) == size:
                yield TAGS.get(tag, str(tag)), " ".join(map(str, struct.unpack(f"{order}{n}{NUMBERS[kind]}", raw)))
        after = at + 2 + 12 * count
        if after + 4 <= len(data) and (next_ := struct.unpack_from(order + "I", data, after)[0]):
            todo.append(next_)


def iptc_tags(data: bytes) -> Iterator[tuple[str, object]]:
    at = data.find(b"\x1c\x02")
    while 0 <= at and at + 5 <= len(data) and data[at : at + 2] == b"\x1c\x02":
        size = int.from_bytes(data[at + 3 : at + 5], "big")
        yield IPTC.get(data[at + 2], str(data[at + 2])), data[at + 5 : at + 5 + size].decode("utf-8", "replace")
        at += 5 + size


def icc_texts(profile: bytes) -> Iterator[tuple[str, str]]:
    """(tag, text) of a colour profile's text, description and localised tags."""
    if profile[36:40] != b"acsp" or len(profile) < 132:
        return
    for k in range(min(struct.unpack_from(">I", profile, 128)[0], 200)):
        entry = profile[132 + 12 * k : 144 + 12 * k]
        if len(entry) < 12:
            return
        name, at, size = struct.unpack(">4sII", entry)
        data, tag = profile[at : at + size], f"ICC {name.decode('latin-1').strip()}"
        if data[:4] == b"text":
            yield tag, data[8:].rstrip(b"\0").decode("latin-1")
        elif data[:4] == b"desc" and len(data) >= 12:
            yield tag, data[12 : 12 + int.from_bytes(data[8:12], "big")].rstrip(b"\0").decode("latin-1")
        elif data[:4] == b"mluc" and len(data) >= 16:
            for i in range(min(int.from_bytes(data[8:12], "big"), 200)):
                record = data[16 + 12 * i : 28 + 12 * i]
                if len(record) == 12:
                    n, from_ = struct.unpack_from(">II", record, 4)
                    yield tag, data[from_ : from_ + n].decode("utf-16-be", "replace")


def icc_profile(body: bytes) -> bytes:
    """The colour profile of a JPEG (its parts joined in order) or PNG; empty if there is none."""
    parts = sorted((data[12], data[14:]) for marker, _, data in jpeg_segments(body) if marker == 0xE2 and data[:12] == b"ICC_PROFILE\0" and len(data) > 14)
    for kind, data in png_chunks(body):
        if kind == "iCCP":
            return inflate(data.partition(b"\0")[2][1:], ZLIB) or b""
    return b"".join(p for _, p in parts)


FIELD = re.compile(r"""(?P<name>[A-Za-z_][\w.-]*:[\w.-]+)\s*=\s*(?P<quote>["'])(?P<value>.*?)(?P=quote)""", re.DOTALL)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*:[\w.-]+)(?:\s[^<>]*)?>(?P<value>[^<]+)</(?P=name)\s*>")


def xmp_fields(packet: str) -> Iterator[tuple[str, str]]:
    """(name, text) of the attributes and the elements without children of an XMP packet; declarations of names aside."""
    text = packet.encode("latin-1", "replace").decode("utf-8", "replace")
    for m in (*FIELD.finditer(text), *ELEMENT.finditer(text)):
        if not m["name"].startswith("xmlns:"):
            yield m["name"], entities(m["value"].strip())


def metadata(body: bytes) -> Iterator[tuple[str, object]]:
    """Tags of EXIF and IPTC in JPEG, PNG, WebP and TIFF files, and texts of colour profiles."""
    yield from icc_texts(icc_profile(body))
    for marker, _, data in jpeg_segments(body):
        if marker == 0xE1 and data[:6] == b"Exif\0\0":
            yield from tiff_tags(data[6:])
        elif marker == 0xED and data[:13] == b"Photoshop 3.0":
            yield from iptc_tags(data)
    for kind, data in png_chunks(body):
        if kind == "eXIf":
            yield from tiff_tags(data)
    if body[:4] in (b"II*\0", b"MM\0*"):
        yield from tiff_tags(body)
    elif body[:4] == b"RIFF" and body[8:12] == b"WEBP" and (at := body.find(b"EXIF", 12)) >= 0:
        data = body[at + 8 : at + 8 + int.from_bytes(body[at + 4 : at + 8], "little")]
        yield from tiff_tags(data[6:] if data[:6] == b"Exif\0\0" else data)


def readings(value: object) -> Iterator[tuple[str, str]]:
    """(encoding, text) of the ways to read a tag: bytes may be text in several encodings, after a marker of eight bytes."""
    if not isinstance(value, bytes):
        yield "", str(value)
        return
    yield "raw bytes", value.decode("latin-1")
    marker = value[:8].rstrip(b"\0").decode("latin-1").upper()
    known = marker in ("UNICODE", "ASCII", "JIS")
    rest, prefix = (value[8:], f"{marker} ") if known else (value, "")
    yield f"{prefix}utf-8", text_of(rest)
    if len(rest) % 2 == 0:
        for name in ("utf-16le", "utf-16be"):
            yield f"{prefix}{name}", rest.decode(name, "replace")


def xmp_packet(body: bytes) -> str | None:
    raw = body.decode("latin-1")
    at = raw.find("<x:xmpmeta")
    if at < 0:
        return None
    end = raw.find("</x:xmpmeta>", at)
    return raw[at : at + XMP_MOST if end < 0 else end + 12]


def size(body: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of PNG, JPEG, GIF, BMP and extended WebP."""
    if body[:4] == PNG and len(body) > 24:
        return struct.unpack_from(">II", body, 16)
    if body[:2] == b"\xff\xd8":
        for marker, at, _ in jpeg_segments(body):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return struct.unpack_from(">HH", body, at + 5)[::-1] if at + 9 < len(body) else None
        return None
    if body[:3] == b"GIF" and len(body) > 10:
        return struct.unpack_from("<HH", body, 6)
    if body[:2] == b"BM" and len(body) > 26:
        w, h = struct.unpack_from("<ii", body, 18)
        return w, abs(h)
    if re.match(rb"RIFF....WEBPVP8X", body, re.DOTALL) and len(body) > 30:
        return 1 + int.from_bytes(body[24:27], "little"), 1 + int.from_bytes(body[27:30], "little")
    return None
