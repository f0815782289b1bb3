"""The crawl as a fixpoint over stored pages.

Links of all pages are collected and keyed once, in one Python worker for each task. Then every level joins the frontier to them, keeps what is neither
known nor refused, and becomes the next frontier, until a level brings nothing new. Order is (depth, order of the page
in its level, order on the page); it decides what is first seen, and what a template's budget goes to. Tables are cut
off from their lineage at every level, so a long crawl recovers from lost executors at the level it is in. Of the levels
before, a level reads what is known by address, and sums by template; not their pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gleaner.functions import url as U
from gleaner.functions.text import shape_hash
from gleaner.operators.discover import candidates, kept
from gleaner.runtime import prepare, settle

#: Levels after which the tables of several levels become one, so that plans of a long crawl stay small.
PACK = 16
#: Pages whose links a Python worker holds at a time.
SOME = 64
#: Parts in which the new URLs of a template are counted first.
SALTS = 16


@dataclass(frozen=True)
class TrapRules:
    """A template is closed after `sample` pages of at most `shapes` shapes that led nowhere else, or at `most` URLs."""

    sample: int = 25
    shapes: int = 2
    most: int = 500


@dataclass
class Crawl:
    """Tables of a crawl: frontier (url, depth, seq, provenance), discoveries, templates, skipped (reason, n), pending (as
    frontier: what a limit left unvisited; empty without one)."""

    frontier: DataFrame
    discoveries: DataFrame
    templates: DataFrame
    skipped: DataFrame
    pending: DataFrame

    @property
    def stats(self) -> DataFrame:
        """One row: known, visited, pending, off_host, unusable, discoveries, trapped."""
        n = lambda df, name: df.agg(F.count("*").alias(name))
        why = lambda name: F.coalesce(F.sum(F.when(F.col("reason") == name, F.col("n"))), F.lit(0)).alias(name)
        known = self.frontier.select("visited").unionByName(self.pending.select("visited")).agg(F.count("*").alias("known"), F.count_if("visited").alias("visited"))
        return known.crossJoin(n(self.pending, "pending")).crossJoin(self.skipped.agg(why("off_host"), why("unusable"), why("trapped"))).crossJoin(n(self.discoveries, "discoveries"))  # each side is one row


def ordered(df: DataFrame, base: int, *order: str) -> DataFrame:
    """seq by a distributed sort: rows in range order from base, which is above all of the level before."""
    return df.orderBy(*order).withColumn("seq", F.lit(base).cast("long") + F.monotonically_increasing_id())


def packed(parts: list[DataFrame]) -> list[DataFrame]:
    return [settle(union(parts, ""), "levels")] if len(parts) >= PACK else parts


def templates_of(visited: DataFrame, enqueued: DataFrame, rules: TrapRules) -> DataFrame:
    """State of each template: enqueued, fetched, distinct_shapes, outbound_novelty, saturated, reason, example; from sums
    by level: visited (template, shape, fetched, novelty) and enqueued (template, n, first, example)."""
    queued = enqueued.groupBy("template").agg(F.sum("n").alias("enqueued"), F.min_by("example", "first").alias("example"))
    seen = visited.groupBy("template").agg(F.sum("fetched").alias("fetched"), F.countDistinct("shape").alias("distinct_shapes"), F.sum("novelty").alias("outbound_novelty"))
    t = queued.join(seen, "template", "left").na.fill(0, ["fetched", "distinct_shapes", "outbound_novelty"])
    trap = (F.col("fetched") >= rules.sample) & (F.col("distinct_shapes") <= rules.shapes) & (F.col("outbound_novelty") == 0)
    full = F.col("enqueued") >= rules.most
    reason = F.when(trap, F.concat(F.col("fetched").cast("string"), F.lit(" pages came in "), F.col("distinct_shapes").cast("string"), F.lit(" shape(s) and led nowhere else"))).when(full, F.lit(f"cap of {rules.most} URLs reached"))
    return t.withColumn("saturated", trap | full).withColumn("reason", reason)


VISITED, QUEUED = "template string, shape string, fetched long, novelty long", "template string, n long, first long, example string"
LINK = ["page", "ord", "raw_url", "source", "detail"]


KEYED = "page string, ord int, raw_url string, source string, detail string, url string, template string"


def addressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (url, html) by their key, with its template; those without one are left out."""
    for batch in batches:
        keys = [None if u is None else U.canonical(u) for u in batch.column(0).to_pylist()]
        at = [i for i, k in enumerate(keys) if k is not None]
        own = [keys[i] for i in at]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([U.template(k) for k in own], pa.string()), batch.column(1).take(pa.array(at, pa.int64()))], names=["url", "template", "html"])


def linked(rows: list[tuple]) -> pa.RecordBatch:
    """Links (page, ord, raw_url, source, detail) with the key that they lead to and its template."""
    keys = [None if r[2] is None else U.canonical(r[2], r[0]) for r in rows]
    columns = [*(zip(*rows, strict=True) if rows else [()] * len(LINK)), keys, [None if k is None else U.template(k) for k in keys]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "ord" else pa.string()) for n, c in zip([*LINK, "url", "template"], columns, strict=True)], names=[*LINK, "url", "template"])


def keyed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of pages (url, html) with their keys. A task has one worker for all of it, and holds the links of some pages."""
    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            some = batch.slice(at, SOME)
            yield linked([(page, *link) for page, html in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for link in kept(candidates(html or ""))])


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of links that are known already; those of pages without a key are left out."""
    for batch in batches:
        rows = ((r["page"] and U.canonical(r["page"]), *(r[c] for c in LINK[1:])) for r in batch.to_pylist())
        yield linked([r for r in rows if r[0]])


def judged(links: DataFrame, host: str | None) -> DataFrame:
    """Links with the reason for which they aren't followed; without a template then."""
    links = links.withColumn("reason", F.when(F.col("url").isNull(), "unusable").when(F.lit(host is not None) & ~U.same_host("url", F.lit(host or "")), "off_host"))
    return links.withColumn("template", F.when(F.col("reason").isNull(), F.col("template")))


def crawl(
    pages: DataFrame, seeds: list[str], host: str | None = None, rules: TrapRules | None = TrapRules(), depth: int | None = None, resume: DataFrame | None = None,
    max_pages: int | None = None, more: DataFrame | None = None, log: Callable[..., None] | None = None,
) -> Crawl:
    """Crawls `pages` (url, html) from the seeds. host: only URLs of it (with its port) are followed; None follows all.
    depth: levels to visit; None goes on until a level brings nothing new. The level after the last one is pending.
    max_pages: URLs that are taken from the frontier at most, in its order; the others that are known then are pending.
    resume: URLs (url) that count as known and visited. A page stored more than once counts once. more: links (page, ord,
    raw_url, source, detail) besides those on the pages, after them in order, also of addresses that are no pages. log: gets depth, known and taken at each level."""
    spark: SparkSession = prepare(pages.sparkSession)
    stored = settle(pages.select("url", "html").mapInArrow(addressed, "url string, template string, html string").dropDuplicates(["url"]), "pages")
    found = stored.select("url", "html").mapInArrow(keyed_links, KEYED)
    if more is not None:
        found = found.unionByName(more.select("page", (F.col("ord") + (1 << 24)).cast("int").alias("ord"), *LINK[2:]).mapInArrow(keyed, KEYED))
    found = settle(judged(found, host), "links")
    shapes = settle(stored.select("url", shape_hash("html").alias("shape"), "template"), "shapes")

    start = spark.createDataFrame(pa.Table.from_batches([linked([("", i, s, "seed", None) for i, s in enumerate(seeds)])])).withColumn("from_seq", F.lit(0).cast("long"))
    level = judged(start, host).select("from_seq", *LINK, "url", "reason", "template")
    known = resume.select("url").distinct() if resume is not None else empty(spark, "url string")
    queues, logs, visits, counts, skips, base, taken, pending = [], [], [], [], [], 0, 0, None
    for k in count():
        queues, logs, visits, counts, skips = map(packed, (queues, logs, visits, counts, skips))
        level = settle(ordered(level, base, "from_seq", "ord", "raw_url"), "level")
        base = 1 + (level.agg(F.max("seq").alias("seq")).first().seq or base)
        skips.append(level.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")))
        usable = level.where("reason is null")
        logs.append(usable.select("seq", F.col("url").alias("key"), "raw_url", F.col("page").alias("discovered_from"), "source", "detail"))
        new = usable.join(known, "url", "left_anti").groupBy("url").agg(F.min("seq").alias("seq"), F.min_by(F.struct("raw_url", "page", "source", "detail", "template"), "seq").alias("s")).select("url", "seq", "s.*")
        if rules is not None:
            state = templates_of(union(visits, VISITED), union(counts, QUEUED), rules).select("template", F.col("enqueued").alias("before"), "saturated")
            # the budget of a template is used up in order. Of a hot template each of SALTS parts passes on its first
            # `most` rows only, so that no task orders more than SALTS times as many
            salt = F.pmod(F.xxhash64("url"), F.lit(SALTS))
            early = F.row_number().over(Window.partitionBy("template", salt).orderBy("seq")) <= rules.most
            new = new.join(state, "template", "left").withColumn("early", early).withColumn("part", F.when(F.col("early"), -1).otherwise(salt))
            turn = F.row_number().over(Window.partitionBy("template", "part").orderBy("seq")) + F.coalesce("before", F.lit(0))
            new = new.withColumn("allowed", ~F.coalesce("saturated", F.lit(False)) & F.col("early") & (turn <= rules.most))
        else:
            new = new.withColumn("allowed", F.lit(True))
        new = settle(new.select("url", "seq", "raw_url", F.col("page").alias("discovered_from"), "source", "detail", "template", "allowed"), "new")
        skips.append(new.where("not allowed").groupBy(F.lit("trapped").alias("reason")).agg(F.count("*").alias("n")))
        new = new.where("allowed").drop("allowed")
        n = new.count()
        if log is not None:
            log(depth=k, known=taken + n, taken=taken)
        if not n:
            break
        left = lambda df: df.withColumn("depth", F.lit(k)).withColumn("visited", F.lit(False))
        if k == depth or taken == max_pages:
            pending = left(new)
            break
        if max_pages is not None and taken + n > max_pages:
            own = settle(new.orderBy("seq").limit(max_pages - taken), "taken")
            pending, new, n = left(new.join(own.select("url"), "url", "left_anti")), own, max_pages - taken
        taken += n
        page = settle(new.join(shapes.drop("template"), "url").select("url", "seq", "template", "shape"), "visit")
        queues.append(new.withColumn("depth", F.lit(k)).join(page.select("url", F.lit(True).alias("visited")), "url", "left").na.fill(False, ["visited"]))
        counts.append(new.groupBy("template").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min_by("url", "seq").alias("example")))
        known = settle(known.union(new.select("url")), "known")
        level = new.select(F.col("url").alias("page"), F.col("seq").alias("from_seq")).join(found, "page").select("from_seq", "page", "ord", "raw_url", "source", "detail", "url", "reason", "template")
        # novelty of a page: URLs that it was the first to find, outside its own template
        fresh = level.where("reason is null").join(known, "url", "left_anti").groupBy("url", "template").agg(F.min_by("page", F.struct("from_seq", "ord")).alias("page"))
        counted = page.alias("p").join(fresh.alias("f"), F.col("p.url") == F.col("f.page"), "left").groupBy("p.url", "p.template", "p.shape").agg(F.count_if(F.col("f.template") != F.col("p.template")).alias("novelty"))
        visits.append(settle(counted.groupBy("template", "shape").agg(F.count("*").alias("fetched"), F.sum("novelty").alias("novelty")), "visits"))
        if pending is not None:
            break
    frontier = union(queues, "url string, seq long, raw_url string, discovered_from string, source string, detail string, template string, depth int, visited boolean", spark)
    skipped = union(skips, "reason string, n long", spark).groupBy("reason").agg(F.sum("n").alias("n"))
    templates = templates_of(union(visits, VISITED, spark), union(counts, QUEUED, spark), rules or TrapRules(sample=1 << 60, most=1 << 60))
    return Crawl(frontier, union(logs, "seq long, key string, raw_url string, discovered_from string, source string, detail string", spark), templates, skipped, frontier.where("false") if pending is None else pending)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows; without the Python workers that a list of rows goes through."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def union(parts: list[DataFrame], schema: str, spark: SparkSession | None = None) -> DataFrame:
    spark = spark or SparkSession.active()
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark, schema)


def trap_states(visits: DataFrame, rules: TrapRules = TrapRules()) -> DataFrame:
    """The trap guard over a log of fetches (template, seq, shape, novelty): state after each fetch, and the first
    fetch at which its template closes. A running window per template; shapes are bounded by what closes one."""
    w = Window.partitionBy("template").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    new_shape = F.row_number().over(Window.partitionBy("template", "shape").orderBy("seq")) == 1
    v = visits.withColumn("__new", new_shape.cast("int"))
    v = v.withColumns({"fetched": F.count("*").over(w), "distinct_shapes": F.sum("__new").over(w), "outbound_novelty": F.sum("novelty").over(w)}).drop("__new")
    closes = (F.col("fetched") >= rules.sample) & (F.col("distinct_shapes") <= rules.shapes) & (F.col("outbound_novelty") == 0)
    return v.withColumn("saturated", F.max(closes.cast("int")).over(w) == 1)
