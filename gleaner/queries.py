"""The engine's registered queries: Spark on one side, SQL for the same rows on the other where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import decode as D
from gleaner.functions import text as X
from gleaner.functions import url as U
from gleaner.grammar import Grammar
from gleaner.operators import discover
from gleaner.operators import relational as R
from gleaner.operators.channels import Artifact, json_values
from gleaner.operators.extract import extract
from gleaner.operators.registry import default_registry
from gleaner.plans.frontier import TrapRules, crawl, trap_states
from gleaner.runtime import discard, settle, shared_dir, table
from gleaner.sources import planted
from gleaner.sources.store import Store, observe, of_host, read_index, recover_empty, rendered_dom, split, write_index
from gleaner.streaming.streams import event_windows, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# artifacts ------------------------------------------------------------------------------------------------------


def captured(spark: SparkSession, d: str) -> DataFrame:
    """Pages, documents and conversations as captures."""
    text = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8").alias("body")
    pages = table(spark, d, "pages").select("url", text(F.col("html")), F.lit("Text/HTML; charset=UTF-8").alias("content_type"), F.col("page_id").alias("seq"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("http://corpus.test/d/"), F.col("doc_id").cast("string")).alias("url"), text(F.col("text")), F.lit("text/plain").alias("content_type"), (F.col("doc_id") + F.lit(1 << 40)).alias("seq"))
    talks = table(spark, d, "conversations").select(F.concat_ws("/", F.lit("http://chat.test"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("url"), text(F.col("text")), F.lit("").alias("content_type"), (F.col("conv_id") * 10000 + F.col("turn") + F.lit(1 << 50)).alias("seq"))
    return pages.unionByName(docs).unionByName(talks)


ARTIFACTS = """a AS (
  SELECT url, encode(coalesce(html, '')) AS body, 'text/html' AS mime FROM pages
  UNION ALL SELECT 'http://corpus.test/d/' || doc_id, encode(coalesce(text, '')), 'text/plain' FROM documents
  UNION ALL SELECT 'http://chat.test/' || conv_id || '/' || turn, encode(coalesce(text, '')), 'application/octet-stream' FROM conversations)"""


@query(f"WITH {ARTIFACTS} SELECT coalesce(mime, 'TOTAL') AS mime_type, count(*) AS count, CAST(sum(octet_length(body)) AS BIGINT) AS bytes FROM a GROUP BY ROLLUP (mime)")
def artifact_inventory(spark, d):
    return R.inventory(observe(captured(spark, d)))


@query(f"WITH {ARTIFACTS} SELECT url, sha256(body) AS sha256, octet_length(body) AS byte_length, mime AS mime_type FROM a")
def sha256_bodies(spark, d):
    return observe(captured(spark, d)).select("url", "sha256", "byte_length", "mime_type")


@query(f"WITH {ARTIFACTS} SELECT url, 'bodies/' || substr(sha256(body), 1, 2) || '/' || sha256(body) || CASE mime WHEN 'text/html' THEN '.html' WHEN 'text/plain' THEN '.txt' ELSE '.bin' END AS body_path FROM a")
def body_paths(spark, d):
    return observe(captured(spark, d)).select("url", "body_path")


@query(f"WITH {ARTIFACTS} SELECT mime AS mime_type, count(*) AS observations, count(DISTINCT sha256(body)) AS bodies, CAST(sum(octet_length(body)) AS BIGINT) AS bytes FROM a GROUP BY mime")
def by_content_type(spark, d):
    return R.by_mime(observe(captured(spark, d)))


@query(f"WITH {ARTIFACTS}, s AS (SELECT count(*) AS o, count(DISTINCT sha256(body)) AS b FROM a) SELECT o AS observations, b AS bodies, o - b AS collapsed, printf('%.1f%%', 100.0 * (o - b) / o) AS share FROM s")
def dedupe_stats(spark, d):
    return R.dedupe_stats(observe(captured(spark, d)))


@query(f"WITH {ARTIFACTS}, s AS (SELECT count(*) AS n, count(DISTINCT sha256(body)) AS b FROM (SELECT DISTINCT url, body FROM a)) SELECT 1 AS turn, n AS new_observations, b AS new_bodies FROM s UNION ALL SELECT 2, 0, 0 UNION ALL SELECT 3, n, b FROM s")
def put_idempotent(spark, d):
    """Puts everything twice, and reports what was new each time and what the store then has."""
    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    rows = [(k, *store.put(captured(spark, d))) for k in (1, 2)]
    rows.append((3, store.observations.count(), store.unique_bodies()))
    return spark.createDataFrame(rows, "turn int, new_observations long, new_bodies long")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.webmanifest' WHEN 2 THEN '.woff2' WHEN 3 THEN '.q' || o_custkey % 10 ELSE '.bin' END AS extension FROM orders"""
)
def mime_extension(spark, d):
    k = F.col("o_orderkey") % 5
    mime = F.when(k == 0, "application/x-javascript").when(k == 1, "application/manifest+json").when(k == 2, "font/woff2").otherwise("x/unknown")
    url = F.when(k == 3, F.concat(F.lit("https://h.test/a.b/file.Q"), (F.col("o_custkey") % 10).cast("string"), F.lit("?x=.png"))).otherwise("http://h.test/a.html/none")
    return table(spark, d, "orders").select("o_orderkey", X.extension_for(mime, url).alias("extension"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'application/x-www-form-urlencoded' ELSE 'image/png' END AS mime,
  o_orderkey % 4 = 0 AS textual, o_orderkey % 4 IN (0, 2) AS textual_wide, (o_orderkey % 3 <> 0) AND 195 + o_orderkey % 120 BETWEEN 200 AND 299 AND 195 + o_orderkey % 120 NOT IN (204, 205) AND o_custkey % 7 <> 0 AS has_body FROM orders"""
)
def http_predicates(spark, d):
    k = F.col("o_orderkey") % 4
    content_type = F.when(k == 0, " Text/HTML ; charset=utf-8").when(k == 1, "").when(k == 2, "application/x-www-form-urlencoded").otherwise("image/png")
    method, size = F.when(F.col("o_orderkey") % 3 == 0, "head").otherwise("GET"), F.when(F.col("o_custkey") % 7 == 0, "0")
    mime = X.mime_of(content_type)
    return table(spark, d, "orders").select("o_orderkey", mime.alias("mime"), X.is_textual(mime).alias("textual"), X.is_textual(mime, wide=True).alias("textual_wide"), X.should_have_body(195 + F.col("o_orderkey") % 120, method, size).alias("has_body"))


# URLs -----------------------------------------------------------------------------------------------------------

PARTS = """u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
p AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')) AS ps FROM u)"""


@query(f"WITH {PARTS} SELECT page_id, scheme || '://' || host || path || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url FROM p")
def normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize_url("url", F.lit(None).cast("string")).alias("url"))


@query(f"""WITH {PARTS}, k AS (SELECT *, list_filter(ps, lambda x: NOT regexp_full_match(x, '(utm_[a-z]+|ref|source|v|hl|lang)=.*')) AS ks FROM p)
SELECT page_id, scheme || '://' || host || path || CASE WHEN len(ks) > 0 THEN '?' || array_to_string(ks, '&') ELSE '' END AS key FROM k""")
def canonical_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_key("url", F.lit(None).cast("string")).alias("key"))


@query(f"""WITH {PARTS}, t AS (SELECT page_id, array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_full_match(s, '[pP]?[0-9]+') THEN '{{n}}' ELSE s END), '/') AS path,
  list_sort(list_transform(ps, lambda x: regexp_replace(x, '=[0-9]+$', '={{n}}'))) AS qs FROM p)
SELECT page_id, path || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS template FROM t""")
def template_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.template_key("url").alias("template"))


@query(f"WITH {PARTS} SELECT host, count(*) AS pages, count(*) FILTER (WHERE host = 'spam-farm.example.org') AS same FROM p GROUP BY host")
def same_host(spark, d):
    own = table(spark, d, "pages").select(U.url_host("url").alias("host"), U.same_host(U.normalize_url("url", F.lit(None).cast("string")), F.lit("Spam-Farm.example.org")).alias("same"))
    return own.groupBy("host").agg(F.count("*").alias("pages"), F.count_if("same").alias("same"))


@query(r"""SELECT page_id, len(list_distinct(list_concat(regexp_extract_all(html, 'https?://[^\s"''`<>()\\]+'), regexp_extract_all(html, '["''`]((?:\.{0,2}/)[^"''`\s<>()\\]{1,300})["''`]', 1)))) AS n FROM pages""")
def url_literals(spark, d):
    """Literals of each page, against another host than any page's, so that no two spellings meet."""
    return table(spark, d, "pages").select("page_id", F.size(U.url_literals("html", F.lit("http://base.invalid/x/"))).alias("n"))


@query(r"""SELECT url AS page, CAST(i - 1 AS INTEGER) AS ord, a[i] AS raw_url FROM (SELECT url, regexp_extract_all(html, '<a href="([^"#][^"]*)"', 1) AS a, unnest(range(1, len(regexp_extract_all(html, '<a href="([^"#][^"]*)"', 1)) + 1)) AS i FROM pages)""")
def anchor_links(spark, d):
    return discover.links(table(spark, d, "pages")).where("source = 'anchor'").select("page", "ord", "raw_url")


def planted_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("http://h.test/"), F.col("page_id").cast("string")).alias("url"), F.replace(F.lit(planted.PAGE.replace("{{", "{").replace("}}", "}")), F.lit("{0}"), F.col("page_id").cast("string")).alias("html"))


@query("SELECT 'http://h.test/' || page_id AS page, source, replace(written, '{0}', CAST(page_id AS VARCHAR)) AS raw_url FROM pages, (VALUES " + ", ".join(f"('{s}', '{u}')" for s, u in planted.LINKED) + ") t(source, written)")
def link_sources(spark, d):
    """Links of every kind, planted in each page."""
    return discover.links(planted_pages(spark, d)).select("page", "source", "raw_url")


@query("SELECT 'http://h.test/' || page_id AS page, '/send' || page_id AS action, 'post' AS method FROM pages")
def posted_forms(spark, d):
    return discover.posted_forms(planted_pages(spark, d)).select("page", "action", "method")


@query("""SELECT 'http://h.test/' || page_id AS page, CAST(0 AS INTEGER) AS ord, 'div "d"' AS description FROM pages""")
def clickable_elements(spark, d):
    return discover.clickable_elements(planted_pages(spark, d))


@query("SELECT page_id, 'rendered-dom' AS kind, sha256(html || '<i></i>') AS sha256, 'text/html' AS mime_type FROM pages WHERE page_id % 3 <> 0")
def rendered_pages(spark, d):
    """Rendered documents of one host, beside responses of the same addresses; every third page is of another host."""
    p = table(spark, d, "pages").select(F.concat(F.when(F.col("page_id") % 3 == 0, "http://o.test/").otherwise("http://H.test/"), F.col("page_id").cast("string")).alias("url"), F.concat("html", F.lit("<i></i>")).alias("html"), F.col("page_id").alias("seq"))
    return observe(of_host(rendered_dom(p), "h.test")).select(F.col("seq").alias("page_id"), "kind", "sha256", "mime_type")


@query("""SELECT page_id, ['/n' || page_id, 'http://o.test/p'] AS targets, 'm' || page_id || '.js.map' AS map FROM pages""")
def header_targets(spark, d):
    i = F.col("page_id").cast("string")
    header = F.concat(F.lit("</n"), i, F.lit('>; rel="next", <http://o.test/p>; rel=prev'))
    return table(spark, d, "pages").select("page_id", X.link_targets(header).alias("targets"), X.source_mapping_url(F.concat(F.lit("x();\n//# sourceMappingURL=m"), i, F.lit(".js.map \n"))).alias("map"))


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '[a-z]+(?:\.[0-9]+)?@[a-z0-9]+\.example\.com') AS tok FROM documents), p AS (SELECT doc_id, text, tok, instr(text, tok) AS k, length(text) AS n FROM t WHERE tok <> ''),
c AS (SELECT *, greatest(1, k - 60) AS a, least(n, k + length(tok) - 1 + 60) AS b FROM p)
SELECT doc_id, CASE WHEN a > 1 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, a, b - a + 1), '\s+', ' ', 'g')) || CASE WHEN b < n THEN '…' ELSE '' END AS context FROM c""")
def excerpts(spark, d):
    """What stands around the first mail address of each document."""
    docs = table(spark, d, "documents").select("doc_id", "text", X.token_places("text", MAIL).alias("p")).where(F.size("p") > 0)
    return docs.select("doc_id", X.excerpt("text", F.col("p")[0]["at"], F.length(F.col("p")[0]["token"])).alias("context"))


@query("""WITH e AS (SELECT 'k' || user_id % 100 AS key, event_id, user_id, event_type FROM events),
s AS (SELECT key, string_agg(event_type, ', ' ORDER BY f) AS sources FROM (SELECT key, event_type, min(event_id) AS f FROM e GROUP BY ALL) GROUP BY key)
SELECT key, min(event_id) AS seq, 'u' || arg_min(user_id, event_id) AS first_seen_on, 'r' || min(event_id) AS raw_url, any_value(sources) AS sources FROM e JOIN s USING (key) GROUP BY key""")
def inventory_first_seen(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("k"), (F.col("user_id") % 100).cast("string")).alias("key"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("raw_url"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("discovered_from"), F.col("event_type").alias("source"))
    return R.url_inventory(log)


# text -----------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, len(regexp_extract_all(html, '<!--([\s\S]*?)-->', 1)) AS n, sha256(array_to_string(regexp_extract_all(html, '<!--([\s\S]*?)-->', 1), '|')) AS digest FROM pages")
def html_comments(spark, d):
    c = F.regexp_extract_all("html", F.lit(r"<!--([\s\S]*?)-->"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(c).alias("n"), F.sha2(F.array_join(c, "|"), 256).alias("digest"))


@query(r"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '<([a-zA-Z][\w-]*)', 1), lambda x: lower(x)) AS t FROM pages)
SELECT page_id, sha256('tags:' || array_to_string(list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]), ' ')) AS shape FROM t""")
def shape_hash(spark, d):
    return table(spark, d, "pages").select("page_id", X.shape_hash("html").alias("shape"))


@query(r"SELECT doc_id, sha256('text:' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9a-fA-F]{6,}', '#', 'g'), '\d+', '#', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS shape FROM documents")
def masked_shape(spark, d):
    return table(spark, d, "documents").select("doc_id", X.shape_hash("text").alias("shape"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')) AS digest FROM pages")
def entity_decode(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(D.decode_entities("html"), 256).alias("digest"))


@query("SELECT doc_id, sha256(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM')) AS digest FROM documents")
def rot13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.rot13("text"), 256).alias("digest"))


@query("SELECT doc_id, text AS decoded FROM documents")
def percent_decode(spark, d):
    """Decodes what was encoded; a null is a failure."""
    coded = F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))
    return table(spark, d, "documents").select("doc_id", X.percent_decode(coded).alias("decoded"))


@query("SELECT c_custkey, c_name AS js, c_name AS css FROM customer")
def escape_decode(spark, d):
    hexed = lambda before: F.array_join(F.transform(F.split("c_name", ""), lambda c: F.concat(F.lit(before), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))), "")
    return table(spark, d, "customer").select("c_custkey", D.decode_js(hexed("\\u")).alias("js"), D.decode_css(F.replace(hexed("\\00"), F.lit("\\0000"), F.lit("\\0000"))).alias("css"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\x20-\x7e]{6,}')) AS n, sha256(array_to_string(regexp_extract_all(text, '[\x20-\x7e]{6,}'), chr(10))) AS digest FROM documents")
def printable_runs(spark, d):
    r = X.printable_runs(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", F.size(r).alias("n"), F.sha2(F.array_join(r, "\n"), 256).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls, regexp_replace(substr(text, 1, length(text) // 2), '\s+', ' ', 'g') AS v FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(ls, lambda x: NOT contains(v, x)), chr(10))) AS digest FROM l""")
def visible_diff(spark, d):
    """What of each document its first half doesn't show."""
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.sha2(X.hidden_text("text", half), 256).alias("digest"))


@query("""SELECT page_id, CASE WHEN length(html) > 90 THEN substr(html, 1, 87) || '…' ELSE html END AS short, replace(replace(html, '|', '\\|'), chr(10), ' ') AS cell, printf('%.1f%%', 100.0 * (page_id % 8) / 8) AS share FROM pages""")
def report_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.short("html").alias("short"), X.escape_pipes("html").alias("cell"), X.percent(F.col("page_id") % 8, F.lit(8)).alias("share"))


@query("SELECT event_id, '$.' || json_keys(props)[1] || ' (key)' AS path, json_keys(props)[1] AS value FROM events")
def json_walk(spark, d):
    """Keys and string values of each event's properties, with their paths."""

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, m, v) for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m, v in json_values(Artifact("application/json", "response", "", "", (p or "").encode()))]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([m.removeprefix("at ") for m in columns[1]], pa.string()), pa.array(columns[2], pa.string())], names=["event_id", "path", "value"])

    return table(spark, d, "events").select("event_id", "props").mapInArrow(walk, "event_id long, path string, value string")


# tokens ---------------------------------------------------------------------------------------------------------

MAIL = Grammar(custom=r"[a-z]+(?:\.[0-9]+)?@[a-z0-9]+\.example\.com")
LONG_HEX = Grammar(custom=r"[0-9a-f]{40}")


def _tokens(grammar: Grammar):
    def run(spark: SparkSession, d: str) -> DataFrame:
        places = X.token_places("text", grammar)
        found = table(spark, d, "documents").select("doc_id", F.col("text"), places.alias("p")).where(F.size("p") > 0)
        return found.select("doc_id", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["token"]), "|").alias("tokens"), F.col("p")[0]["at"].alias("first_at"))

    return run


for _name, _grammar in (("mail_tokens", MAIL), ("hex_tokens", LONG_HEX)):
    QUERIES[_name] = _tokens(_grammar)
    SQL[_name] = f"WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{_grammar.pattern}') AS ts FROM documents) SELECT doc_id, len(ts) AS n, array_to_string(ts, '|') AS tokens, instr(text, ts[1]) AS first_at FROM t WHERE len(ts) > 0"


@query("SELECT doc_id, 'TOKEN{' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16) || '}' AS token FROM documents")
def confusable_repair(spark, d):
    digits = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 16)
    seen = F.concat(F.lit("so TOKEN { "), F.translate(digits, "0125", "OlZS"), F.lit("} TOKEN{zzz}"))
    return table(spark, d, "documents").select("doc_id", F.explode(X.repair_confusables(seen)).alias("token"))


#: Parts by digest in which planted artifacts are read one after another. Observations and bodies meet by digest, so a part
#: is whole by itself, and only one part's shuffles and bodies' hits are on the disk at a time.
PARTS = 4


@query("SELECT doc_id, c.channel, 'TOKEN{' || substr(md5(doc_id || ':' || c.channel), 1, 16) || '}' AS token FROM documents, (VALUES " + ", ".join(f"('{c}')" for c in planted.CHANNELS) + ") c(channel)")
def planted_hits(spark, d):
    """Tokens planted in every channel for every document id, found by the channel that they were planted in."""
    captures = settle(planted.captures(table(spark, d, "documents"), "doc_id"), "planted", lean=True)
    observations, bodies = split(captures)
    # the path has the digest again, and follows from it
    seen = settle(observations.drop("body_path"), "observations", lean=True)
    observations = seen.withColumn("body_path", X.body_path("sha256", "mime_type", F.col("url")))
    parts = []
    for k in range(PARTS):
        own = F.pmod(F.xxhash64("sha256"), F.lit(PARTS)) == k
        found = extract(observations.where(own), bodies.where(own), stepwise=True)
        parts.append(settle(found.hits.select(*R.ORDER, "token", "source_url", "method", "extractor"), "hits", lean=True))
        discard(*found.settled)
    discard(captures, seen)
    every = reduce(DataFrame.unionByName, parts)
    hits = R.dedupe_hits(every)
    parts = F.split("source_url", "/")
    own = hits.select(F.regexp_extract(F.element_at(parts, -1), r"^(\d+)", 1).cast("long").alias("doc_id"), F.element_at(parts, -2).alias("channel"), "extractor", "token")
    return own.where("channel = extractor").select("doc_id", "channel", "token").distinct()


@query(r"SELECT url, CAST(len(regexp_extract_all(html, '[a-z]+(?:\.[0-9]+)?@[a-z0-9]+\.example\.com')) * CASE WHEN octet_length(encode(html)) > length(html) THEN 2 ELSE 1 END AS BIGINT) AS n_hits FROM pages")
def page_raw_hits(spark, d):
    """Mail addresses that the first channel finds in each page: once as UTF-8, and as Latin-1 too where that is another text."""
    observations, bodies = split(captured(spark, d).where("content_type like 'Text%'"))
    found = extract(observations, bodies, grammar=MAIL)
    own = found.results.where("extractor = 'raw-text'").select("seq", "n_hits")
    return observations.join(own, "seq").select("url", "n_hits")


@query(f"WITH {ARTIFACTS} SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS lost, (SELECT count(*) FROM documents) AS artifacts, (SELECT count(DISTINCT body) FROM a WHERE mime = 'text/plain' AND CAST(split_part(url, '/', 5) AS BIGINT) % 3 <> 0) AS bodies")
def missing_bodies(spark, d):
    """A third of the documents has lost its body: they can't be read, and don't count among the bodies."""
    observations, bodies = split(captured(spark, d).where("url like 'http://corpus%'").withColumn("body", F.when(F.col("seq") % 3 == (1 << 40) % 3, F.concat(F.col("body"), F.lit(b"gone"))).otherwise(F.col("body"))))
    there = observations.where(F.col("seq") % 3 != (1 << 40) % 3).select("sha256").distinct()
    found = extract(observations, bodies.join(there, "sha256", "left_semi"))
    return R.totals(observations, found.unreadable).crossJoin(found.unreadable.agg(F.count("*").alias("lost")))  # one row each


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN sha256(html) ELSE sha256('') END AS sha256, CASE WHEN page_id % 2 = 0 THEN octet_length(encode(html)) ELSE 0 END AS byte_length FROM pages")
def recovered_bodies(spark, d):
    """Pages captured without their bodies; those of even number were captured again later."""
    p = table(spark, d, "pages").select(F.concat(F.lit("http://h.test/"), F.col("page_id").cast("string")).alias("url"), F.encode("html", "UTF-8").alias("body"), F.lit("text/html").alias("content_type"), F.col("page_id").alias("seq"))
    caps = p.withColumn("body", F.lit(b"")).unionByName(p.where("seq % 2 = 0").withColumn("seq", F.col("seq") + (1 << 40)))
    return recover_empty(split(caps)[0]).where(F.col("seq") < 1 << 40).select(F.col("seq").alias("page_id"), "sha256", "byte_length")


@query("SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 4) AS renderable, o_orderkey % 3 <> 0 AS navigable FROM orders")
def page_predicates(spark, d):
    mime = F.element_at(F.array(*map(F.lit, ("text/html", "Image/SVG+xml", "application/json", "text/plain", "application/xhtml+xml"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    url = F.element_at(F.array(*map(F.lit, ("http://h.test/a/b.WOFF2?x=1", "http://h.test/file.pdf.html", "http://h.test/zip?f=a.zip"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", X.is_renderable(mime).alias("renderable"), X.is_navigable(url).alias("navigable"))


@query("SELECT 'http://h.test/' || o_orderkey AS url FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 1")
def captured_urls(spark, d):
    """Of responses and other captures with all kinds of status, what a resumed crawl needn't fetch again."""
    caps = table(spark, d, "orders").select(
        F.concat(F.lit("http://h.test/"), F.col("o_orderkey").cast("string")).alias("url"), F.lit(b"x").alias("body"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 7 == 0, 404).otherwise(200 + F.col("o_orderkey") % 7 * 30).cast("int").alias("status"), F.when(F.col("o_orderkey") % 4 == 1, "storage").otherwise("response").alias("kind"),
    )
    store = Store(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    store.put(caps)
    return store.captured_urls()


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS byte_length, coalesce(text, '') AS body FROM documents")
def store_round_trip(spark, d):
    """Documents put into a store, read back through its index in JSON lines, with their bodies."""
    at = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    store = Store(spark, at)
    store.put(captured(spark, d).where("url like 'http://corpus%'"))
    write_index(store.observations, f"{at}/index")
    back = read_index(spark, f"{at}/index").join(store.bodies, "sha256")
    return back.select(F.element_at(F.split("url", "/"), -1).cast("long").alias("doc_id"), "sha256", "byte_length", F.col("body").cast("string").alias("body"))


@query()
def page_coverage(spark, d):
    """Coverage of pages by all channels, for mail addresses."""
    observations, bodies = split(captured(spark, d).where("content_type like 'Text%'"))
    return R.coverage(extract(observations, bodies, grammar=MAIL).results)


# relations over hits --------------------------------------------------------------------------------------------

IDS = default_registry().ids
RANKS = {c.id: c.rank for c in default_registry().channels}
H = (
    "h AS (SELECT l_orderkey AS seq, CAST(l_suppkey % 26 AS INTEGER) AS extractor_ord, CAST(l_linenumber AS BIGINT) AS hit_ord, 'T' || l_partkey % 60 AS token, 'u' || l_orderkey % 40 AS source_url, "
    "l_returnflag || l_linestatus AS method, CASE l_suppkey % 26 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(IDS)) + " END AS extractor, 'm' || l_orderkey % 5 AS mime_type FROM lineitem)"
)
RANK = "CASE extractor " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items()) + " END"


def line_hits(spark: SparkSession, d: str) -> DataFrame:
    """Line items seen as hits: their keys give order, tokens, sources and channels."""
    name = F.element_at(F.array(*map(F.lit, IDS)), (F.col("l_suppkey") % 26 + 1).cast("int"))
    text = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), (F.col("l_suppkey") % 26).cast("int").alias("extractor_ord"), F.col("l_linenumber").cast("long").alias("hit_ord"), text("T", "l_partkey", 60).alias("token"), text("u", "l_orderkey", 40).alias("source_url"), F.concat("l_returnflag", "l_linestatus").alias("method"), name.alias("extractor"), text("m", "l_orderkey", 5).alias("mime_type"))


@query(f"WITH {H} SELECT seq, extractor_ord, hit_ord, token, source_url, method FROM (SELECT *, row_number() OVER (PARTITION BY token, source_url, method ORDER BY seq, extractor_ord, hit_ord) AS n FROM h) WHERE n = 1")
def dedupe_hits(spark, d):
    return R.dedupe_hits(line_hits(spark, d)).select("seq", "extractor_ord", "hit_ord", "token", "source_url", "method")


@query(f"WITH {H} SELECT token, seq, extractor, r AS rank FROM (SELECT *, {RANK} AS r, row_number() OVER (PARTITION BY token ORDER BY {RANK} DESC, seq, extractor_ord, hit_ord) AS n FROM h) WHERE n = 1")
def best_hit(spark, d):
    return R.best_hits(line_hits(spark, d), default_registry()).select("token", "seq", "extractor", "rank")


@query(f"WITH {H} SELECT token, count(*) AS n, min(seq) AS first_seq FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY {RANK} DESC, seq, extractor_ord, hit_ord) AS n FROM h) WHERE n > 1 GROUP BY token")
def also_seen_in(spark, d):
    return R.also_seen_in(line_hits(spark, d), default_registry()).groupBy("token").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"WITH {H} SELECT DISTINCT token FROM h")
def unique_tokens(spark, d):
    return R.unique_tokens(line_hits(spark, d))


@query(f"WITH {H} SELECT token, seq, row_number() OVER (ORDER BY seq, extractor_ord, hit_ord) AS known FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY seq, extractor_ord, hit_ord) AS n FROM h) WHERE n = 1")
def running_unique(spark, d):
    return R.running_tokens(line_hits(spark, d)).select("token", "seq", F.col("known").cast("long").alias("known"))


@query(f"WITH {H} SELECT extractor, count(*) AS hits FROM h GROUP BY extractor")
def hits_by_channel(spark, d):
    return R.hits_by_channel(line_hits(spark, d))


RESULTS = "r AS (SELECT seq, mime_type, extractor, extractor_ord, hit_ord % 4 <> 0 AS applied, CASE WHEN extractor IN ('ocr', 'font') THEN 0 ELSE hit_ord % 3 END AS n_hits, hit_ord = 5 AS failed FROM h)"


def line_results(spark: SparkSession, d: str) -> DataFrame:
    quiet = F.col("extractor").isin("ocr", "font")
    return line_hits(spark, d).select("seq", "mime_type", F.lit("").alias("artifact_path"), "extractor_ord", "extractor", (F.col("hit_ord") % 4 != 0).alias("applied"), F.when(quiet, 0).otherwise(F.col("hit_ord") % 3).cast("long").alias("n_hits"), F.when(F.col("hit_ord") == 5, "failed").alias("error"))


COVERAGE = "c AS (SELECT mime_type, extractor, count(*) FILTER (WHERE applied) AS applied, CAST(coalesce(sum(n_hits) FILTER (WHERE applied), 0) AS BIGINT) AS hits, count(*) FILTER (WHERE applied AND failed) AS errors FROM r GROUP BY ALL)"


@query(f"WITH {H}, {RESULTS}, {COVERAGE} SELECT * FROM c")
def coverage(spark, d):
    return R.coverage(line_results(spark, d))


CELL = "CASE WHEN applied = 0 THEN '—' ELSE applied || '/' || hits || CASE WHEN errors > 0 THEN ' ⚠' || errors ELSE '' END END"


@query(f"WITH {H}, {RESULTS}, {COVERAGE} SELECT mime_type, " + ", ".join(f"coalesce(max({CELL}) FILTER (WHERE extractor = '{i}'), '—') AS \"{i.replace('-', '_')}\"" for i in IDS) + " FROM c GROUP BY mime_type")
def coverage_pivot(spark, d):
    wide = R.coverage_matrix(line_results(spark, d), default_registry())
    return wide.withColumnsRenamed({i: i.replace("-", "_") for i in IDS})


@query(f"WITH {H}, {RESULTS} SELECT i.id AS extractor FROM (VALUES " + ", ".join(f"('{i}')" for i in IDS) + ") i(id) WHERE i.id NOT IN (SELECT extractor FROM r WHERE n_hits > 0)")
def channels_without_hits(spark, d):
    return R.without_hits(line_results(spark, d), default_registry()).select("extractor")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def count_by_source(spark, d):
    return R.count_by(table(spark, d, "events"), "event_type", "event_id")


# crawl ----------------------------------------------------------------------------------------------------------

SITE = "http://site.test/p/"


def site(spark: SparkSession, d: str) -> DataFrame:
    """A site with a page for each stored page: each links to two others (the last ones to pages that aren't there),
    once by a decorated address, back to the first, and off host."""
    i = F.col("page_id")
    html = F.concat(
        F.lit(f'<html><body><p><b>x</b></p><a href="{SITE}k'), (2 * i + 1).cast("string"), F.lit('/">x</a><a href="/p/k'), (2 * i + 2).cast("string"),
        F.lit('/?utm_source=a#t">y</a><a href="../k0/">up</a><a href="https://other.test/">z</a><a href="mailto:a@b">m</a></body></html>'),
    )
    return table(spark, d, "pages").select(F.concat(F.lit(SITE + "k"), i.cast("string"), F.lit("/")).alias("url"), html.alias("html"))


FRONTIER = """WITH RECURSIVE e AS (SELECT page_id AS a, 2 * page_id + k AS b FROM pages, (VALUES (1), (2)) t(k)),
r(i, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.i),
f AS (SELECT i, min(depth) AS depth FROM r GROUP BY i)"""


@query(FRONTIER + f" SELECT '{SITE}k' || i || '/' AS url, CAST(depth AS INTEGER) AS depth, i IN (SELECT page_id FROM pages) AS visited FROM f")
def frontier_levels(spark, d):
    return crawl(site(spark, d), [SITE + "k0/"], host="site.test", rules=None).frontier.select("url", "depth", "visited")


@query(FRONTIER + ", v AS (SELECT count(*) AS v FROM f JOIN pages ON i = page_id) SELECT (SELECT count(*) FROM f) AS known, v AS visited, CAST(0 AS BIGINT) AS pending, v AS off_host, v AS unusable, CAST(0 AS BIGINT) AS trapped, 3 * v + 1 AS discoveries FROM v")
def frontier_stats(spark, d):
    return crawl(site(spark, d), [SITE + "k0/"], host="site.test", rules=None).stats


@query(FRONTIER + f" SELECT '{SITE}k' || i || '/' AS url, i < 7 AS taken FROM f WHERE i < 15")
def page_budget(spark, d):
    """A crawl that may take seven URLs: what it took, and what is pending then."""
    c = crawl(site(spark, d), [SITE + "k0/"], host="site.test", rules=None, max_pages=7)
    return c.frontier.select("url", F.lit(True).alias("taken")).unionByName(c.pending.select("url", F.lit(False).alias("taken")))


@query("""WITH RECURSIVE r(i) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT i + 1 FROM r WHERE i + 1 < least(5, (SELECT count(*) FROM pages)))
SELECT '/r/?page={n}' AS template, count(*) AS enqueued, count(*) AS fetched, CAST(1 AS BIGINT) AS distinct_shapes, CAST(0 AS BIGINT) AS outbound_novelty, count(*) >= 5 AS saturated, 'http://site.test/r/?page=0' AS example FROM r""")
def trapped_crawl(spark, d):
    """Pages numbered without end, of one shape: the guard closes their template."""
    p = table(spark, d, "pages").select("page_id")
    html = F.concat(F.lit('<html><body><p>a</p><a href="/r/?page='), (F.col("page_id") + 1).cast("string"), F.lit('">next</a></body></html>'))
    pages = p.select(F.concat(F.lit("http://site.test/r/?page="), F.col("page_id").cast("string")).alias("url"), html.alias("html"))
    return crawl(pages, ["http://site.test/r/?page=0"], host="site.test", rules=TrapRules(sample=5)).templates.drop("reason")


@query("""WITH v AS (SELECT event_type || user_id % 7 AS template, event_id AS seq, CAST(user_id % 3 AS VARCHAR) AS shape, CASE WHEN user_id % 7 = 3 AND event_id % 50 = 0 THEN 1 ELSE 0 END AS novelty FROM events),
w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY template, shape ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM v),
x AS (SELECT template, seq, count(*) OVER o AS fetched, CAST(sum(fresh) OVER o AS BIGINT) AS distinct_shapes, CAST(sum(novelty) OVER o AS BIGINT) AS outbound_novelty FROM w WINDOW o AS (PARTITION BY template ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT *, max(CASE WHEN fetched >= 25 AND distinct_shapes <= 3 AND outbound_novelty = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY template ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AS saturated FROM x""")
def trap_saturated(spark, d):
    e = table(spark, d, "events")
    v = e.select(F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("template"), F.col("event_id").alias("seq"), (F.col("user_id") % 3).cast("string").alias("shape"), F.when((F.col("user_id") % 7 == 3) & (F.col("event_id") % 50 == 0), 1).otherwise(0).cast("long").alias("novelty"))
    return trap_states(v, TrapRules(shapes=3)).select("template", "seq", "fetched", "distinct_shapes", "outbound_novelty", "saturated")


# extension: event time ------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_hours(spark, d):
    return event_windows(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k""")
def event_sessions(spark, d):
    return sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
