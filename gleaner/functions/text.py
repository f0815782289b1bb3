"""Text and byte functions as Columns: everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.grammar import BLANKS, DEFAULT, PAD, Grammar

BLANK = f"[{BLANKS}]"
TEXTUAL = "(?i)(json|javascript|ecmascript|xml|svg|yaml|csv|x-sh|sourcemap)"
TEXTUAL_WIDE = "(?i)(json|javascript|ecmascript|xml|svg|yaml|csv|x-sh|sourcemap|urlencoded)"

# File extension of each content type.
EXTENSIONS = {
    "text/html": ".html", "text/css": ".css", "text/plain": ".txt", "text/csv": ".csv", "text/xml": ".xml", "text/javascript": ".js",
    "application/javascript": ".js", "application/x-javascript": ".js", "application/json": ".json",
    "application/manifest+json": ".webmanifest", "application/xml": ".xml", "application/rss+xml": ".xml", "application/atom+xml": ".xml",
    "application/pdf": ".pdf", "application/zip": ".zip", "application/gzip": ".gz", "application/wasm": ".wasm",
    "application/octet-stream": ".bin", "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp",
    "image/avif": ".avif", "image/svg+xml": ".svg", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico", "image/bmp": ".bmp",
    "image/tiff": ".tif", "audio/mpeg": ".mp3", "audio/ogg": ".ogg", "audio/wav": ".wav", "video/mp4": ".mp4", "video/webm": ".webm",
    "font/woff": ".woff", "font/woff2": ".woff2", "font/ttf": ".ttf", "font/otf": ".otf", "application/font-woff": ".woff",
    "application/x-font-ttf": ".ttf",
}

# How content types begin that a page is rendered from, and endings of paths that no page is expected at.
RENDERED = ("text/html", "application/xhtml+xml", "text/xml", "application/xml", "image/svg")
NO_PAGE = ("pdf", "zip", "gz", "tgz", "tar", "wasm", "woff", "woff2", "ttf", "otf", "mp3", "mp4", "webm", "ogg", "wav", "bin")

# Glyphs that look like a hex digit, and that digit.
CONFUSED, MEANT = "lIi|OoQDSsZzBGgqT/([", "111100005522869977cc"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf8(body: Column | str) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(col(body).cast("string"))


def latin1(body: Column | str) -> Column:
    return F.decode(col(body), "ISO-8859-1")


def mime_of(content_type: Column | str) -> Column:
    bare = F.lower(F.trim(F.split_part(F.coalesce(col(content_type), F.lit("")), F.lit(";"), F.lit(1))))
    return F.when(bare == "", "application/octet-stream").otherwise(bare)


def is_textual(mime: Column | str, wide: bool = False) -> Column:
    """wide: as extraction sees it, form data included."""
    return col(mime).startswith("text/") | col(mime).rlike(TEXTUAL_WIDE if wide else TEXTUAL)


def is_renderable(mime: Column | str) -> Column:
    low = F.lower(col(mime))
    return reduce(Column.__or__, (low.startswith(x) for x in RENDERED))


def is_navigable(url: Column | str) -> Column:
    return ~F.lower(url_path(url)).rlike(rf"\.({'|'.join(NO_PAGE)})$")


def should_have_body(status: Column | str, method: Column | str, content_length: Column | str) -> Column:
    status = col(status)
    return (F.upper(col(method)) != "HEAD") & status.between(200, 299) & ~status.isin(204, 205) & ~F.coalesce(col(content_length) == "0", F.lit(False))


def url_path(url: Column | str) -> Column:
    """Path of a URL with a scheme and host, else the string itself."""
    return F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), col(url))


def extension_for(mime: Column | str, url: Column | str) -> Column:
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    suffix = F.lower(F.regexp_extract(url_path(url), r"\.([A-Za-z0-9]{1,6})$", 1))
    return F.coalesce(F.try_element_at(known, col(mime)), F.when(suffix != "", F.concat(F.lit("."), suffix)), F.lit(".bin"))


def body_path(sha: Column | str, mime: Column | str, url: Column | str) -> Column:
    return F.concat(F.lit("bodies/"), F.substring(col(sha), 1, 2), F.lit("/"), col(sha), extension_for(mime, url))


def collapse(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"{BLANK}+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def tokens(text: Column | str, grammar: Grammar = DEFAULT) -> Column:
    """Tokens in order, without the published example."""
    every = F.regexp_extract_all(col(text), F.lit(grammar.pattern), F.lit(0))
    return F.filter(every, lambda t: F.lower(t) != grammar.published.lower())


def token_places(text: Column | str, grammar: Grammar = DEFAULT) -> Column:
    """array<struct<token, at>> with the 1-based place of each, found by walking from one match to the next."""
    text = col(text)
    every = F.regexp_extract_all(text, F.lit(grammar.pattern), F.lit(0))
    empty = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<token:string,at:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, acc["next"])
        return F.struct((at + F.length(t)).alias("next"), F.concat(acc["out"], F.array(F.struct(t.alias("token"), at.alias("at")))).alias("out"))

    return F.filter(F.aggregate(every, empty, step)["out"], lambda x: F.lower(x["token"]) != grammar.published.lower())


def excerpt(text: Column | str, at: Column, length: Column, pad: int = PAD) -> Column:
    text = col(text)
    start, end = F.greatest(F.lit(1), at - pad), F.least(F.length(text), at + length - 1 + pad)
    return F.concat(F.when(start > 1, "…").otherwise(""), strip(collapse(F.substring(text, start, end - start + 1))), F.when(end < F.length(text), "…").otherwise(""))


def repair_confusables(text: Column | str, grammar: Grammar = DEFAULT) -> Column:
    """Token-shaped runs whose digits were misread, put right where that gives hex digits."""
    inner = F.regexp_extract_all(col(text), F.lit(f"{grammar.prefix}{BLANK}*\\{{{BLANK}*([^}}]{{10,32}}){BLANK}*\\}}"), F.lit(1))
    fixed = F.transform(inner, lambda x: F.translate(F.regexp_replace(x, f"{BLANK}+", ""), CONFUSED, MEANT))
    return F.transform(F.filter(fixed, lambda x: x.rlike(f"^[0-9a-fA-F]{{{grammar.digits}}}$")), lambda x: F.concat(F.lit(grammar.prefix + "{"), x, F.lit("}")))


def rot13(text: Column | str) -> Column:
    low = "abcdefghijklmnopqrstuvwxyz"
    turned = low[13:] + low[:13]
    return F.translate(col(text), low + low.upper(), turned + turned.upper())


def percent_decode(text: Column | str) -> Column:
    """The whole text percent-decoded: + stays, a lone % too; null where the bytes aren't UTF-8."""
    text = col(text)
    safe = F.replace(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    out = F.try_url_decode(safe)
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\ufffd"), F.lit("")))
    written = F.size(F.regexp_extract_all(text, F.lit("(?i)%EF%BF%BD"), F.lit(0)))
    return F.when(marks(out) == marks(text) + written, out)


def printable_runs(body: Column | str, least: int = 6) -> Column:
    return F.regexp_extract_all(latin1(body), F.lit(f"[\\x20-\\x7e]{{{least},}}"), F.lit(0))


def tag_sequence(html: Column | str) -> Column:
    """Names of the open tags, lower case, repeats in a row once."""
    tags = F.transform(F.regexp_extract_all(col(html), F.lit(r"<([a-zA-Z][\w-]*)"), F.lit(1)), F.lower)
    return F.zip_with(tags, F.concat(F.array(F.lit("")), F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0)))), lambda t, before: F.when(t != before, t))


def shape_hash(body: Column | str) -> Column:
    """Digest of a page's structure: its tags, or masked text where it has fewer than four."""
    text = col(body)
    count = F.size(F.regexp_extract_all(text, F.lit(r"<([a-zA-Z][\w-]*)"), F.lit(1)))
    by_tags = F.concat(F.lit("tags:"), F.array_join(F.filter(tag_sequence(text), lambda t: t.isNotNull()), " "))
    masked = strip(collapse(F.regexp_replace(F.regexp_replace(text, "(?i)[0-9a-f]{6,}", "#"), r"\d+", "#")))
    return F.sha2(F.when(count >= 4, by_tags).otherwise(F.concat(F.lit("text:"), masked)), 256)


def hidden_text(every: Column | str, visible: Column | str) -> Column:
    """Lines of the whole text that aren't part of the visible text, white space aside. White space is cleaned once for a
    text, not for each line: the visible text is bound by a one-element array."""
    clean = F.regexp_replace(col(every), f"[{BLANKS}&&[^\\n]]+", " ")
    lines = F.filter(F.transform(F.split(clean, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(F.array(collapse(visible)), lambda seen: F.array_join(F.filter(lines, lambda x: ~F.contains(seen, x)), "\n"))[0]


def short(url: Column | str) -> Column:
    return F.when(F.length(col(url)) > 90, F.concat(F.substring(col(url), 1, 87), F.lit("…"))).otherwise(col(url))


def escape_pipes(text: Column | str) -> Column:
    return F.replace(F.replace(col(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def percent(part: Column | str, total: Column | str) -> Column:
    return F.when(col(total) == 0, "0%").otherwise(F.concat(F.format_number(100.0 * col(part) / col(total), 1), F.lit("%")))


def link_targets(header: Column | str) -> Column:
    """Targets of a Link header."""
    return F.regexp_extract_all(F.coalesce(col(header), F.lit("")), F.lit("<([^>]+)>"), F.lit(1))


def source_mapping_url(text: Column | str) -> Column:
    return F.regexp_extract(col(text), rf"sourceMappingURL=({'[^' + BLANKS + ']'}+)", 1)


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
