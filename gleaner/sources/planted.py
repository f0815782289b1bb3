"""Artifacts with a token planted in a known channel: what tests and queries measure recall by."""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import prepare

CAPTURE = "url string, body binary, content_type string, kind string, resource_type string, headers map<string,string>, request_headers map<string,string>, seq long"


def token(key: object, channel: str, prefix: str = "TOKEN") -> str:
    return f"{prefix}{{{hashlib.md5(f'{key}:{channel}'.encode()).hexdigest()[:16]}}}"


#: A page with a link of every kind; {0} is the page's number. The links, as (source, URL as written), stand in LINKED.
PAGE = (
    '<html><head><base href="/base{0}/"><link rel="next" href="l{0}"><meta http-equiv="refresh" content="3; url=/refresh{0}">'
    '<style>@import "imported{0}.css"; p{{background:url(style{0}.png)}}</style><script src="s{0}.js"></script><script>go("/literal{0}")</script></head><body>'
    '<a href="a{0}">1</a><map><area href="area{0}"></map><img src="i{0}.png" srcset="i{0}.png 1x, big{0}.png 2x" data-src="late{0}"><iframe src="if{0}"></iframe>'
    '<frameset><frame src="fr{0}"></frameset><embed src="e{0}"><object data="o{0}"></object><audio src="au{0}"></audio>'
    '<video src="v{0}" poster="po{0}"><source src="so{0}"><track src="t{0}"></video><form action="/find{0}?old=1"><input name="q" value="x y"><input type="checkbox" name="c" checked>'
    '<input type="submit" name="no" value="no" formaction="fi{0}"><button formaction="fb{0}">b</button></form><form method="post" action="/send{0}"><input name="z"></form>'
    '<svg><use href="u{0}"/><image href="im{0}"/></svg><div data-goto="/data{0}" style="background:url(inline{0}.png)" onclick="open(\'/click{0}\')">d</div></body></html>'
)
LINKED = (
    ("anchor", "a{0}"), ("area", "area{0}"), ("link-rel", "l{0}"), ("base", "/base{0}/"), ("img", "i{0}.png"), ("data-attribute", "late{0}"), ("script-src", "s{0}.js"),
    ("iframe", "if{0}"), ("frame", "fr{0}"), ("embed", "e{0}"), ("object", "o{0}"), ("source", "so{0}"), ("track", "t{0}"), ("source", "au{0}"), ("source", "v{0}"),
    ("poster", "po{0}"), ("form-action", "/find{0}?old=1"), ("form-action", "/send{0}"), ("formaction", "fi{0}"), ("formaction", "fb{0}"), ("svg-href", "u{0}"), ("svg-href", "im{0}"),
    ("srcset", "i{0}.png"), ("srcset", "big{0}.png"), ("data-attribute", "/data{0}"), ("meta-refresh", "/refresh{0}"), ("css-import", "imported{0}.css"), ("stylesheet-url", "style{0}.png"),
    ("inline-style-url", "inline{0}.png"), ("clickable-element", "/click{0}"), ("js-string-literal", "/literal{0}"), ("form-get", "/find{0}?q=x+y&c=on"),
)


def png(texts: dict[str, bytes], after: bytes = b"", width: int = 1, height: int = 1) -> bytes:
    """An image of one colour with text chunks by kind (their data, keyword included)."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = zlib.compress(b"".join(b"\0" + b"\x7f" * width for _ in range(height)))
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + b"".join(chunk(k.encode(), v) for k, v in texts.items()) + chunk(b"IDAT", rows)
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IEND", b"") + after


def tiff(tag: int, value: bytes, kind: int = 7) -> bytes:
    """A TIFF structure with one tag."""
    head = struct.pack("<2sHIHHHI", b"II", 42, 8, 1, tag, kind, len(value))
    return head + (value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", 26)) + struct.pack("<I", 0) + (value if len(value) > 4 else b"")


def jpeg(segments: list[tuple[int, bytes]]) -> bytes:
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, m, len(d) + 2) + d for m, d in segments) + b"\xff\xd9"


def archive(name: str, content: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def tar(name: str, content: bytes) -> bytes:
    head = bytearray(512)
    head[: len(name)] = name.encode()
    head[124:136] = b"%011o\0" % len(content)
    head[257:263] = b"ustar\0"
    return bytes(head) + content + bytes(-len(content) % 512) + bytes(1024)


def mp3(frame: str, text: str) -> bytes:
    data = b"\x03" + text.encode()
    body = frame.encode() + struct.pack(">IH", len(data), 0) + data
    return b"ID3\x03\0\0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body + bytes(32)


def font(name_id: int, text: str) -> bytes:
    raw = text.encode("utf-16-be")
    table = struct.pack(">HHH6H", 0, 1, 18, 3, 1, 0x409, name_id, len(raw), 0) + raw
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + struct.pack(">4sIII", b"name", 0, 28, len(table)) + table


def woff(name_id: int, text: str) -> bytes:
    table = font(name_id, text)[28:]
    packed = zlib.compress(table)
    return b"wOFF" + bytes(8) + struct.pack(">H", 1) + bytes(30) + struct.pack(">4sIIII", b"name", 64, len(packed), len(table), 0) + packed


def leb(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def wasm(name: str, payload: bytes) -> bytes:
    body = leb(len(name)) + name.encode() + payload
    return b"\0asm\1\0\0\0\0" + leb(len(body)) + body


def pdf(text: str) -> bytes:
    packed = zlib.compress(f"BT /F1 12 Tf ({text}) Tj ET".encode())
    return b"%PDF-1.4\n1 0 obj << /Length " + str(len(packed)).encode() + b" /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n%%EOF"


#: (content type, ending of the URL, body) of an artifact that hides a token in a channel. Two are of headers.
BODIES: dict[str, tuple[str, str, Callable[[str], bytes]]] = {
    "raw-text": ("text/plain", ".txt", lambda t: f"before {t} after".encode()),
    "utf16-text": ("application/octet-stream", ".bin", lambda t: t.encode("utf-16-le")),
    "binary-strings": ("application/octet-stream", ".bin", lambda t: b"\0\1\2" + t.encode() + b"\0\xff"),
    "cookies": ("application/json", "", lambda t: json.dumps({"localStorage": {"k": t}}).encode()),
    "html": ("text/html", ".html", lambda t: f'<html><body><!-- {t} --><p title="x">y</p></body></html>'.encode()),
    "css": ("text/css", ".css", lambda t: ("p::after { content: \"" + "".join(f"\\{ord(c):06x}" for c in t) + '" }').encode()),
    "javascript": ("text/javascript", ".js", lambda t: f"var a = String.fromCharCode({','.join(str(ord(c)) for c in t)});".encode()),
    "sourcemap": ("application/json", ".map", lambda t: json.dumps({"version": 3, "sources": ["a.ts"], "sourcesContent": [f"// {t}"], "names": []}).encode()),
    "json": ("application/json", ".json", lambda t: json.dumps({"config": {"secrets": [{"value": t}]}}).encode()),
    "svg": ("image/svg+xml", ".svg", lambda t: f"<svg><desc>{t}</desc></svg>".encode()),
    "image-metadata": ("image/jpeg", ".jpg", lambda t: jpeg([(0xE1, b"Exif\0\0" + tiff(0x9286, b"UNICODE\0" + t.encode("utf-16-le")))])),
    "image-chunks": ("image/png", ".png", lambda t: png({"zTXt": b"Comment\0\0" + zlib.compress(t.encode())})),
    "trailing-bytes": ("image/png", ".png", lambda t: png({}, after=t.encode())),
    "pdf": ("application/pdf", ".pdf", pdf),
    "archive": ("application/zip", ".zip", lambda t: archive("outer.zip", archive("inner.txt", t.encode()))),
    "media-metadata": ("audio/mpeg", ".mp3", lambda t: mp3("TXXX", t)),
    "font": ("font/ttf", ".ttf", lambda t: font(10, t)),
    "wasm": ("application/wasm", ".wasm", lambda t: wasm("note", t.encode())),
    "base64": ("text/plain", ".txt", lambda t: b"v " + base64.b64encode(t.encode()) + b" w"),
    "hex": ("text/plain", ".txt", lambda t: b"v " + t.encode().hex().encode() + b" w"),
    "escapes": ("text/plain", ".txt", lambda t: codecs.encode(t, "rot13").encode()),
    "compression": ("application/octet-stream", ".bin", lambda t: b"head" + gzip.compress(t.encode(), mtime=0)),
    "data-uri": ("text/plain", ".txt", lambda t: b"x data:text/plain;base64," + base64.b64encode(t.encode()) + b" y"),
}
CHANNELS = (*BODIES, "response-headers", "request-headers")


def captures(ids: DataFrame, key: str, prefix: str = "TOKEN") -> DataFrame:
    """One capture for each id and channel, at http://planted.test/<channel>/<id><ending>."""
    prepare(ids.sparkSession)
    schema = pa.schema([("url", pa.string()), ("body", pa.binary()), ("content_type", pa.string()), ("kind", pa.string()), ("resource_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("request_headers", pa.map_(pa.string(), pa.string())), ("seq", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                for k, channel in enumerate(CHANNELS):
                    t = token(i, channel, prefix)
                    mime, end, build = BODIES.get(channel, ("text/plain", ".txt", lambda _, i=i, c=channel: f"{c} {i}".encode()))
                    rows.append({"url": f"http://planted.test/{channel}/{i}{end}", "body": build(t), "content_type": mime, "kind": "storage" if channel == "cookies" else "response", "resource_type": "other", "headers": {"x-note": t} if channel == "response-headers" else {}, "request_headers": {"cookie": t} if channel == "request-headers" else {}, "seq": i * len(CHANNELS) + k})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ids.select(F.col(key).cast("long")).mapInArrow(run, CAPTURE)



