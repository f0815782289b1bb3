"""Channels, registry, extraction and what is asked of its results."""

import gzip
import io
import json
import tracemalloc
import zipfile
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner import cli, queries
from gleaner.grammar import DEFAULT
from gleaner.kernels import containers, image, inflate, pdf
from gleaner.operators import discover
from gleaner.operators import relational as R
from gleaner.operators.channels import Artifact, Channel, default_channels, lenient64
from gleaner.operators.extract import extract
from gleaner.operators.registry import Registry, default_registry
from gleaner.plans import report
from gleaner.runtime import shared_dir
from gleaner.sources import planted
from gleaner.sources.store import Store, read_bodies, read_index, recover_empty, split, write_index

from .conftest import SMALL

T = planted.token(1, "x")


def found(body, mime="text/plain", url="", kind="response", registry=None):
    """{channel: methods} of the test token."""
    a = Artifact(mime, kind, url, "other", body if isinstance(body, bytes) else body.encode())
    return {o.extractor: [m for _, t, m, _ in o.hits if t == T] for o in (registry or default_registry()).run(a) if o.hits}


@pytest.mark.parametrize("channel", list(planted.BODIES))
def test_planted_in_each_channel(channel):
    mime, end, build = planted.BODIES[channel]
    assert found(build(T), mime, f"x{end}", "storage" if channel == "cookies" else "response").get(channel)


@pytest.mark.parametrize(
    ("channel", "method", "body", "mime"),
    [
        ("html", "img@alt, page source", f'<img alt="{T}">', "text/html"),
        ("html", "after a hidden div, page source", f'<div style="display:none">{T}</div>', "text/html"),
        ("html", "plain text, page source", f"<script>1</script><p>{T}</p>", "text/html"),
        ("css", "comment, page with styles", f"<style>/* {T} */</style>", "text/html"),
        ("css", "generated content, style sheet", f'a{{content:"{T}"}}', "text/css"),
        ("javascript", "line comment, script", f"x // {T}", "text/javascript"),
        ("javascript", "quoted, script", f"a='{T}'", "text/javascript"),
        ("javascript", "escapes undone, script", "".join(f"\\u{ord(c):04x}" for c in T), "text/javascript"),
        ("javascript", "list of character codes, script", f"[{', '.join(str(ord(c)) for c in T)}]", "text/javascript"),
        ("javascript", "put together from pieces, script", " + ".join(f"'{T[i:i + 5]}'" for i in range(0, len(T), 5)), "text/javascript"),
        ("javascript", "backwards, script", T[::-1], "text/javascript"),
        ("json", "at $.a[0] inside.b", json.dumps({"a": [json.dumps({"b": T})]}), "application/json"),
        ("json", f"at $.{T} (key)", json.dumps({T: 1}), "application/json"),
        ("sourcemap", "map: list of names", json.dumps({"sourcesContent": [], "names": [T]}), "application/json"),
        ("svg", "drawing: comment", f"<svg><!-- {T} --></svg>", "image/svg+xml"),
        ("escapes", "percent signs undone", "".join(f"%{ord(c):02x}" for c in T), "text/plain"),
        ("escapes", "entities undone", "".join(f"&#{ord(c)};" for c in T), "text/plain"),
        ("base64", "base64 twice", __import__("base64").b64encode(__import__("base64").b64encode(T.encode() * 2)), "text/plain"),
        ("compression", "unpacked [zlib @ +3]", b"abc" + zlib.compress(T.encode()), "application/octet-stream"),
        ("compression", "unpacked [brotli]", pa.compress(T.encode(), "brotli", asbytes=True), "application/octet-stream"),
        ("archive", "gzip: <gunzipped>", gzip.compress(T.encode()), "application/gzip"),
        ("archive", "tar: a", planted.tar("a", T.encode()), "application/x-tar"),
        ("archive", "zip: o!i", planted.archive("o", planted.archive("i", T.encode())), "application/zip"),
        ("image-chunks", "JPEG comment", planted.jpeg([(0xFE, T.encode())]), "image/jpeg"),
        ("image-chunks", "PNG iTXt k", planted.png({"iTXt": b"k\0\1\0en\0t\0" + zlib.compress(T.encode())}), "image/png"),
        ("image-chunks", "GIF comment", b"GIF89a" + b"\0" * 7 + b"\x21\xfe" + bytes([len(T)]) + T.encode() + b"\0;", "image/gif"),
        ("image-metadata", "XMP packet", planted.jpeg([(0xE1, f"<x:xmpmeta>{T}</x:xmpmeta>".encode())]), "image/jpeg"),
        ("font", "font name 5 (version)", planted.woff(5, T), "font/woff"),
        ("media-metadata", "ID3 ID3v1", bytes(40) + b"TAG" + T.encode().ljust(125, b"\0"), "audio/mpeg"),
        ("media-metadata", "MP4 desc", b"\0\0\0\x10ftypisom\0\0\0\0" + (8 + 8 + len(T)).to_bytes(4, "big") + b"moov" + (8 + len(T)).to_bytes(4, "big") + b"desc" + T.encode(), "video/mp4"),
        ("pdf", "PDF string in hex", f"%PDF-1.4 <{T.encode().hex()}>", "application/pdf"),
        ("trailing-bytes", f"{len(T)} bytes after JPEG EOI", planted.jpeg([]) + T.encode(), "image/jpeg"),
    ],
)
def test_methods(channel, method, body, mime):
    assert method in found(body, mime).get(channel, [])


def test_pdf_objects():
    """Objects in an object stream, a note in UTF-16, a page whose line is in pieces over two streams, and an attachment."""
    wide = "<feff" + T.encode("utf-16-be").hex() + ">"
    inner = f"<< /Type /Annot /Contents {wide} >> << /Title ({T}) >>"
    index = f"11 0 12 {inner.index('<< /Title')} "
    stream = zlib.compress((index + inner).encode())
    half = len(T) // 2
    body = b"%%PDF-1.5\n1 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >>\nstream\n" % len(index) + stream + b"\nendstream\nendobj\n"
    body += b"2 0 obj << /Type /Page /Contents [3 0 R 4 0 R] >> endobj\n"
    for number, part in ((3, T[:half]), (4, T[half:])):
        body += b"%d 0 obj << /Filter [/ASCIIHexDecode] >>\nstream\n" % number + f"BT ({part}) Tj ET".encode().hex().encode() + b">\nendstream\nendobj\n"
    body += b"5 0 obj << /Type /EmbeddedFile /Filter /ASCII85Decode >>\nstream\n" + __import__("base64").a85encode(f"in a file: {T}".encode()) + b"~>\nendstream\nendobj\n"
    methods = found(body, "application/pdf")["pdf"]
    assert {"PDF entry Contents", "PDF entry Title", "text of PDF page 1", "file attached to a PDF"} <= set(methods)
    assert [o.number for o in pdf.objects(body)] == [1, 11, 12, 2, 3, 4, 5]
    broken = b"%PDF-1.5\n1 0 obj << /Type /ObjStm /Filter /FlateDecode >>\nstream\nxx\nendstream\nendobj 2 0 obj << /Filter /ASCII85Decode >>\nstream\n\xff\xff\nendstream endobj"
    assert [o.data for o in pdf.objects(broken)] == [None, None]


def icc(text, kind=b"desc"):
    data = {b"desc": b"desc\0\0\0\0" + len(text).to_bytes(4, "big") + text.encode(), b"text": b"text\0\0\0\0" + text.encode() + b"\0"}.get(kind)
    if data is None:
        data = b"mluc\0\0\0\0" + (1).to_bytes(4, "big") + (12).to_bytes(4, "big") + b"enUS" + (2 * len(text)).to_bytes(4, "big") + (28).to_bytes(4, "big") + text.encode("utf-16-be")
    return bytes(36) + b"acsp" + bytes(88) + (1).to_bytes(4, "big") + b"cprt" + (144).to_bytes(4, "big") + len(data).to_bytes(4, "big") + data


@pytest.mark.parametrize("kind", [b"desc", b"text", b"mluc"])
def test_colour_profiles(kind):
    profile = icc(T, kind)
    jpeg = planted.jpeg([(0xE2, b"ICC_PROFILE\0\2\2" + profile[150:]), (0xE2, b"ICC_PROFILE\0\1\2" + profile[:150])])
    png = planted.png({"iCCP": b"name\0\0" + zlib.compress(profile)})
    assert "image: ICC cprt" in found(jpeg, "image/jpeg")["image-metadata"] and "image: ICC cprt" in found(png, "image/png")["image-metadata"]
    assert list(image.icc_texts(profile[:140])) == [] and list(image.icc_texts(b"")) == []


def test_xmp_fields():
    packet = f'<x:xmpmeta xmlns:x="n"><rdf:Description dc:format="a&amp;b" xmp:Label="{T}"><dc:title><rdf:li xml:lang="x">t {T}</rdf:li></dc:title></rdf:Description></x:xmpmeta>'
    assert ("dc:format", "a&b") in list(image.xmp_fields(packet)) and not any(n.startswith("xmlns") for n, _ in image.xmp_fields(packet))
    assert {"image: xmp:Label", "image: rdf:li"} <= set(found(planted.jpeg([(0xE1, packet.encode())]), "image/jpeg")["image-metadata"])


def test_recovery_forms_and_budget(spark):
    blank = {"content_type": F.lit("text/html")}
    caps = spark.createDataFrame([("http://h/a", b"", 1, 200), ("http://h/a", b"x", 2, 200), ("http://h/b", b"", 3, 200), ("http://h/c", b"", 4, 204), ("http://h/c", b"y", 5, 200), (None, b"", 6, 200)], "url string, body binary, seq long, status int").withColumns(blank)
    got = {r.seq: r.byte_length for r in recover_empty(split(caps)[0]).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0} and recover_empty(split(caps.limit(0))[0]).count() == 0
    pages = spark.createDataFrame([("http://h/", "<form method=POST><input name=a></form><form action=/g></form><form method=put action=/p>"), ("http://h/n", None)], "url string, html string")
    assert sorted((r.page, r.action, r.method) for r in discover.posted_forms(pages).collect()) == [("http://h/", "/p", "put"), ("http://h/", "http://h/", "post")]


def test_cli(spark, tmp_path, monkeypatch, capsys):
    """crawl, report of the crawl before, and what a budget leaves; links in scripts and headers are followed."""
    html = lambda *to: "".join(f'<a href="{x}">x</a>' for x in to).encode()
    rows = [("http://h.test/", html("/a", "/b.zip", "/c"), "text/html", 1), ("http://h.test/a", html("/d") + T.encode() + b"<form method=post action=/s></form>", "text/html", 2), ("http://h.test/b.zip", b"PK", "text/html", 3), ("http://h.test/c", b"fetch('/e')", "text/javascript", 4), ("http://h.test/e", html(), "image/svg+xml", 5)]
    caps = spark.createDataFrame(rows, "url string, body binary, content_type string, seq long")
    Store(spark, f"file://{tmp_path}/s").put(caps)
    for name, value in (("BASE_URL", "http://h.test/"), ("STORE_DIR", f"file://{tmp_path}/s"), ("OUT_DIR", str(tmp_path / "out")), ("MAX_PAGES", "4"), ("LOG_LEVEL", "error")):
        monkeypatch.setenv(name, value)
    assert cli.main(["nothing"]) == 1 and cli.main(["crawl"]) == 0 and "TOTAL" in capsys.readouterr().out
    kept = cli.earlier(Store(spark, f"file://{tmp_path}/s"))
    assert {r.url for r in kept.frontier.collect()} == {"http://h.test/", "http://h.test/a", "http://h.test/b.zip", "http://h.test/c"} and {r.url for r in kept.pending.collect()} == {"http://h.test/d", "http://h.test/e", "http://h.test/s"}
    assert cli.main(["report"]) == 2 and T in capsys.readouterr().out
    text = (tmp_path / "out/crawl-report.md").read_text()
    assert "URLs pending at the end: **3** (stopped before the end)" in text and "### Forms that were not sent" in text and "`/s`" in text
    assert json.loads((tmp_path / "out/tokens.json").read_text())["tokens"][0]["token"] == T
    monkeypatch.setenv("MAX_PAGES", "9")
    assert cli.main(["run"]) == 2
    assert {r.url for r in cli.earlier(Store(spark, f"file://{tmp_path}/s")).frontier.where("visited").collect()} == {"http://h.test/", "http://h.test/a", "http://h.test/e"}


def test_negatives():
    assert not found(DEFAULT.published) and not found(T[:-2] + "}") and not found(T.lower())
    assert "html" not in found("<div hidden>x</div>", "text/html")
    assert "hex" not in found((b"a" * 13).hex())
    assert "base64" not in found("k=" + "A" * 23) and "base64" not in found("TOKEN+0123456789abcdef/" * 2)


def test_failing_channels_stand_alone():
    def fails(a):
        raise RuntimeError("no")

    r = Registry([Channel("bad", "", 1, lambda a: True, fails), Channel("shy", "", 1, fails, fails), *default_channels()])
    out = {o.extractor: o for o in r.run(Artifact("text/plain", "response", "", "", T.encode()))}
    assert (out["bad"].applied, out["bad"].error, out["shy"].applied, out["shy"].error) == (True, "no", False, "no") and out["raw-text"].hits
    with pytest.raises(ValueError):
        r.register(default_channels()[0])
    assert len(set(default_registry().ids)) == 26
    # a code point that doesn't exist fails the channel, not the run
    assert {o.extractor: o.error for o in default_registry().run(Artifact("text/css", "response", "", "", b"\\ffffff x"))}["css"]


def test_ocr_is_a_plug_in():
    seen = T.replace("0", "O").replace("1", "l")
    r = Registry(default_channels(read_image=lambda b: seen))
    assert found(planted.png({}, width=64, height=16), "image/png", registry=r).get("ocr")
    assert image.size(planted.png({}, width=70, height=20)) == (70, 20) and image.size(planted.jpeg([])) is None and image.size(b"<html>") is None


def test_kernels_survive_noise():
    noise = bytes((i * 7919 >> 3) & 255 for i in range(3000))
    for head in (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF89a", b"PK\x03\x04", b"\x1f\x8b\x08", b"ID3\x03", b"wOFF", b"\0asm\1\0\0\0", b"%PDF-", b"II*\0", b""):
        for mime in ("image/png", "application/zip", "font/ttf", "audio/mpeg", "application/pdf", "application/wasm"):
            default_registry().run(Artifact(mime, "response", "", "", head + noise))
    assert list(containers.members(b"PK\x03\x04junk")) == [] and inflate.inflate(zlib.compress(b"abc")[:-3], 15) is None
    deep = T.encode()
    for _ in range(6):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("n", deep)
        deep = out.getvalue()
    assert len(list(containers.members(deep))) == 4
    assert lenient64("TQ==TQ") == b"M" and lenient64("-_-_") == b"\xfb\xff\xbf"


@pytest.fixture(scope="module")
def run(spark):
    ids = spark.range(3).select(F.col("id").alias("doc_id"))
    caps = planted.captures(ids, "doc_id")
    twice = caps.withColumn("url", F.concat("url", F.lit("?copy"))).withColumn("seq", F.col("seq") + 1000)
    observations, bodies = split(caps.unionByName(twice))
    lost = bodies.where(F.col("sha256") != F.sha2(F.lit("request-headers 2").cast("binary"), 256))
    return observations.cache(), lost.cache(), extract(observations, lost)


def test_results_and_hits(run):
    observations, _, e = run
    assert observations.count() == 2 * 3 * len(planted.CHANNELS)
    # the body of one request-headers artifact is missing, at both addresses
    assert e.unreadable.count() == 2 and e.results.where("extractor = '(read)'").count() == 2
    assert e.results.where("extractor_ord >= 0").count() == (observations.count() - 2) * 26
    hits = R.dedupe_hits(e.hits)
    assert R.unique_tokens(hits).count() == 3 * len(planted.CHANNELS) - 1
    best = {r.token: r.extractor for r in R.best_hits(hits, default_registry()).collect()}
    assert best[planted.token(0, "pdf")] == "pdf" and best[planted.token(1, "response-headers")] == "response-headers" and best[planted.token(1, "image-metadata")] == "image-metadata"
    # a snapshot that echoes a token explains it less than the JSON that holds it
    assert best[planted.token(0, "cookies")] == "json"


def test_report(run):
    observations, _, e = run
    text = report.render("http://planted.test/", observations, e, default_registry(), generated="now")
    assert f"- Distinct tokens: **{3 * len(planted.CHANNELS) - 1}**" in text and "| `application/pdf` |" in text and "- `ocr` —" in text and "`(read)`" in text
    written = io.StringIO()
    report.write_tokens(written, R.dedupe_hits(e.hits), default_registry(), "http://b/", "now")
    doc = json.loads(written.getvalue())
    assert doc["count"] == len(doc["tokens"]) and [t["token"] for t in doc["tokens"]] == sorted(t["token"] for t in doc["tokens"])
    assert report.exit_code(8) == 0 and report.exit_code(3) == 2 and report.exit_code(0) == 1


def test_store(spark, run, tmp_path):
    ids = spark.range(2).select(F.col("id").alias("doc_id"))
    store, caps = Store(spark, f"file://{tmp_path}/s"), planted.captures(ids, "doc_id")
    n = 2 * len(planted.CHANNELS)
    assert store.unique_bodies() == 0
    assert store.put(caps) == (n, n) and store.put(caps) == (0, 0) and store.unique_bodies() == n
    changed = caps.withColumn("body", F.concat("body", F.lit(b"!"))).limit(1)
    assert store.put(changed) == (1, 1) and store.observations.count() == n + 1
    index = str(tmp_path / "index")
    write_index(store.observations.coalesce(1), index)
    back = read_index(spark, index)
    plain = [c for c, t in back.dtypes if "map" not in t and c not in ("seq", "discovery")]
    assert back.count() == n + 1 and back.select(plain).exceptAll(store.observations.select(plain)).isEmpty()
    sha = "ab" * 32
    (tmp_path / "d/bodies/ab").mkdir(parents=True)
    (tmp_path / f"d/bodies/ab/{sha}.bin").write_bytes(b"x")
    assert read_bodies(spark, str(tmp_path / "d")).first() == (sha, bytearray(b"x"))


def test_empty(spark):
    observations, bodies = split(planted.captures(spark.range(0).select(F.col("id").alias("doc_id")), "doc_id"))
    e = extract(observations, bodies)
    assert e.results.count() == 0 and e.hits.count() == 0


def test_one_row_for_each_artifact(spark, run):
    """Joins of the extraction carry a row for each observation, not one for each channel of it; what planted_hits wrote
    on the way is gone when its result is there."""
    observations, _, e = run
    assert e.runs.count() == observations.count() - 2
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    out = queries.planted_hits(spark, SMALL)
    assert {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before} == {"gleaner-hits"}
    assert out.count() == 200 * len(planted.CHANNELS)


def test_extraction_by_steps(run):
    """Written or not, what is found is the same."""
    observations, bodies, e = run
    own = extract(observations, bodies, stepwise=True)
    for a, b in ((e.hits, own.hits), (e.results, own.results)):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_failed_decoding_holds_no_memory():
    """Nearly every body isn't brotli; each one used to leave 256 KB behind in its worker."""
    assert inflate.brotli(pa.compress(b"a" * 300_000, codec="brotli", asbytes=True)) == b"a" * 300_000
    tracemalloc.start()
    try:
        assert not any(inflate.brotli(b"no such stream %d" % i) for i in range(64))
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()
