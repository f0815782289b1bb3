"""Link discovery in stored pages and bodies: candidates (seq, ord, raw_url, source, detail), in the order in which a
collector walks a page. What needs a layout engine or a live browser (computed styles, clicks) isn't there."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions import url as U
from gleaner.runtime import prepare

# Which attribute of which element is a URL, and what that is called.
RULES = (
    ("a", "href", "anchor"), ("area", "href", "area"), ("link", "href", "link-rel"), ("base", "href", "base"), ("img", "src", "img"),
    ("img", "data-src", "data-attribute"), ("script", "src", "script-src"), ("iframe", "src", "iframe"), ("frame", "src", "frame"),
    ("embed", "src", "embed"), ("object", "data", "object"), ("source", "src", "source"), ("track", "src", "track"),
    ("audio", "src", "source"), ("video", "src", "source"), ("video", "poster", "poster"), ("form", "action", "form-action"),
    ("button", "formaction", "formaction"), ("input", "formaction", "formaction"), ("use", "href", "svg-href"), ("image", "href", "svg-href"),
)
PATHLIKE = re.compile(r"(?:https?://|/|\.\.?/)\S+")
CSS_URL, CSS_IMPORT = re.compile(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""", re.I), re.compile(r"""@import\s+(?:url\()?\s*['"]?([^'")\s;]+)""", re.I)
LITERAL = re.compile(r"""['"`]((?:https?://|/|\.\.?/)[^'"`\s]{1,300})['"`]""")
REFRESH = re.compile(r"""url\s*=\s*['"]?([^'";]+)""", re.I)
NAVIGATION = re.compile(r"data-(?:href|url|link|target|page|nav|goto)", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Page(HTMLParser):
    """Elements of a page in document order: (tag, attributes, index of the parent), texts of scripts, styles and forms."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, dict[str, str], int]] = []
        self.inside: dict[int, list[str]] = {}
        self.stack: list[int] = []
        self.children: dict[int, int] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        parent = self.stack[-1] if self.stack else -1
        self.children[parent] = self.children.get(parent, 0) + 1
        self.elements.append((tag, {k: v or "" for k, v in reversed(attrs)}, parent))
        if tag not in VOID:
            self.stack.append(len(self.elements) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.stack and self.stack[-1] == len(self.elements) - 1:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.elements[self.stack[k]][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        for k in self.stack[-1:] if self.stack and self.elements[self.stack[-1]][0] in ("script", "style") else self.stack:
            self.inside.setdefault(k, []).append(data)

    def text(self, k: int) -> str:
        return "".join(self.inside.get(k, ()))

    def under(self, k: int, tag: str) -> bool:
        while k >= 0:
            if self.elements[k][0] == tag:
                return True
            k = self.elements[k][2]
        return False


def candidates(html: str) -> Iterator[tuple[str, str, str]]:
    """(url as written, source, detail) of everything on a page that may lead somewhere."""
    page = Page(html)
    for tag, attribute, source in RULES:
        yield from ((a[attribute], source, f"{tag}[{attribute}]") for t, a, _ in page.elements if t == tag and attribute in a)
    for t, a, _ in page.elements:
        for part in a.get("srcset", "").split(","):
            yield (part.split() or [""])[0], "srcset", f"{t}[srcset]"
    for t, a, _ in page.elements:
        yield from ((v, "data-attribute", f"{t}[{k}]") for k, v in a.items() if k.startswith("data-") and PATHLIKE.fullmatch(v.strip()))
    for t, a, _ in page.elements:
        if t == "meta" and a.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.search(a.get("content", ""))):
            yield m[1], "meta-refresh", f'meta[http-equiv=refresh] "{a["content"]}"'
    for k, (t, _, _) in enumerate(page.elements):
        if t == "style":
            yield from ((m[1], "css-import", "@import in inline <style>") for m in CSS_IMPORT.finditer(page.text(k)))
            yield from ((m[1], "stylesheet-url", "url() in inline <style>") for m in CSS_URL.finditer(page.text(k)))
    for _, a, _ in page.elements:
        yield from ((m[1], "inline-style-url", "style attribute") for m in CSS_URL.finditer(a.get("style", "")))
    for t, a, _ in page.elements:
        for k, v in a.items():
            if k.startswith("on"):
                yield from ((m[1], "clickable-element", f"{t}[{k}]") for m in LITERAL.finditer(v))
    for k, (t, a, _) in enumerate(page.elements):
        if t == "script" and "src" not in a:
            yield from ((m[1], "js-string-literal", "inline <script>") for m in LITERAL.finditer(page.text(k)))
    yield from forms(page)


def fields(page: Page, form: int) -> list[tuple[str, str]]:
    """Names and values that a form sends as it stands."""
    out = []
    for k, (t, a, parent) in enumerate(page.elements):
        name = a.get("name", "")
        if not name or t not in ("input", "select", "textarea") or not _within(page, k, form):
            continue
        kind = a.get("type", "text").lower()
        if t == "select":
            options = [o for j, o in enumerate(page.elements) if o[0] == "option" and _within(page, j, k)]
            chosen = next((o for o in options if "selected" in o[1]), options[0] if options else None)
            out.append((name, chosen[1].get("value", "") if chosen else ""))
        elif t == "textarea":
            out.append((name, page.text(k)))
        elif kind not in ("submit", "button", "image", "reset", "file") and (kind not in ("checkbox", "radio") or "checked" in a):
            out.append((name, a.get("value", "on" if kind in ("checkbox", "radio") else "")))
    return out


def _within(page: Page, k: int, outer: int) -> bool:
    while k >= 0 and k != outer:
        k = page.elements[k][2]
    return k == outer


def forms(page: Page) -> Iterator[tuple[str, str, str]]:
    """GET forms as the URL that they lead to with their defaults; other forms are never sent."""
    for k, (t, a, _) in enumerate(page.elements):
        if t == "form" and a.get("method", "get").lower() in ("get", ""):
            query = U.form(fields(page, k))
            yield a.get("action", "").partition("?")[0] + (f"?{query}" if query else "?"), "form-get", "form with default fields"


def posted(html: str) -> Iterator[tuple[str, str, str]]:
    """Forms that are sent by another method than GET, and so never followed: action, method, what they are."""
    for t, a, _ in Page(html).elements:
        method = a.get("method", "get").lower()
        if t == "form" and method not in ("get", ""):
            yield a.get("action", "") or ".", method, "form that is not sent"


def clickables(html: str) -> list[str]:
    """Descriptions of what a user may click besides links: handlers, roles, navigation data. At most three children,
    unless there is a handler or navigation data."""
    page, out = Page(html), []
    for k, (t, a, _) in enumerate(page.elements):
        role = a.get("role", "").lower()
        sure = "onclick" in a or any(NAVIGATION.fullmatch(x) for x in a)
        if t in ("script", "style", "head", "html") or page.under(k, "a") or not (sure or role in ("link", "button")) or (page.children.get(k, 0) > 3 and not sure):
            continue
        out.append(f'{t}{f"[role={role}]" if role else ""} "{" ".join(page.text(k).split())[:60]}"')
    return out


def kept(links: Iterator[tuple[str, str, str]]) -> Iterator[tuple[int, str, str, str]]:
    """(place, url, source, detail) of links that aren't empty and leave the place on the page."""
    return ((i, *link) for i, link in enumerate((u.strip(), s, d) for u, s, d in links if u.strip() and u.strip()[0] != "#"))


def _collector(collect: Callable[[str], Iterator[tuple[str, str, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ords, out = [], [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                own = [link[1:] for link in kept(collect(html or ""))]
                rows += [i] * len(own)
                ords += range(len(own))
                out += own
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ords, pa.int32()), *(pa.array(c, pa.string()) for c in columns)], names=["page", "ord", "raw_url", "source", "detail"])

    return run


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Candidates of each page: page (its URL), ord, raw_url, source, detail. Null pages have none."""
    prepare(pages.sparkSession)
    return pages.select(F.col(url).alias("page"), html).mapInArrow(_collector(candidates), "page string, ord int, raw_url string, source string, detail string")


def posted_forms(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row for each form that isn't sent: page, action, method. Without an action a form belongs to its page."""
    prepare(pages.sparkSession)
    found = pages.select(F.col(url).alias("page"), html).mapInArrow(_collector(posted), "page string, ord int, raw_url string, source string, detail string")
    return found.select("page", "ord", F.when(F.col("raw_url") == ".", F.col("page")).otherwise(F.col("raw_url")).alias("action"), F.col("source").alias("method"))


#: Clickable elements of a page that are listed.
CLICKABLE = 60


def clickable_elements(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The first CLICKABLE elements of each page that a user may click besides links: page, ord, description."""
    prepare(pages.sparkSession)
    listed = lambda text: ((c, "", "") for c in clickables(text)[:CLICKABLE])
    return pages.select(F.col(url).alias("page"), html).mapInArrow(_collector(listed), "page string, ord int, raw_url string, source string, detail string").select("page", "ord", F.col("raw_url").alias("description"))


def written_links(observations: DataFrame, bodies: DataFrame) -> DataFrame:
    """What response bodies, headers and source maps say of other addresses, as more links for a crawl: page, ord,
    raw_url, source, detail. They come after the links of the page itself."""
    of_body = body_literals(observations, bodies).select("page", "ord", F.col("url").alias("raw_url"), "source")
    rest = header_links(observations).unionByName(source_map_links(observations, bodies)).select("page", F.lit(0).alias("ord"), "raw_url", "source")
    return of_body.unionByName(rest).withColumn("detail", F.lit("stored response"))


def body_literals(observations: DataFrame, bodies: DataFrame) -> DataFrame:
    """URLs written in textual bodies, resolved: seq, page, url, source by what kind of text it is."""
    prepare(observations.sparkSession)
    own = observations.where(X.is_textual("mime_type")).join(bodies, "sha256")
    source = F.when(F.col("mime_type").contains("json"), "json-value").when(F.col("mime_type").rlike("(?i)javascript|ecmascript"), "js-string-literal").otherwise("text-url")
    return own.select("seq", F.col("final_url").alias("page"), source.alias("source"), F.posexplode(U.url_literals(X.utf8("body"), F.col("final_url"))).alias("ord", "url"))


def header_links(observations: DataFrame) -> DataFrame:
    """Targets of Link and Location headers: seq, page, raw_url, source."""
    low = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    base = observations.withColumn("__h", low).select("seq", F.col("final_url").alias("page"), F.try_element_at("__h", F.lit("link")).alias("link"), F.try_element_at("__h", F.lit("location")).alias("location"))
    of_link = base.select("seq", "page", F.explode(X.link_targets("link")).alias("raw_url"), F.lit("link-header").alias("source"))
    return of_link.unionByName(base.where("location is not null").select("seq", "page", F.col("location").alias("raw_url"), F.lit("redirect").alias("source")))


def source_map_links(observations: DataFrame, bodies: DataFrame) -> DataFrame:
    own = observations.where(F.col("mime_type").rlike("(?i)javascript|ecmascript|css")).join(bodies, "sha256")
    found = own.select("seq", F.col("final_url").alias("page"), X.source_mapping_url(X.utf8("body")).alias("raw_url"))
    return found.where("raw_url <> '' and not startswith(raw_url, 'data:')").withColumn("source", F.lit("source-mapping-url"))
