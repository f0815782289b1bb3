"""Extraction: observations and bodies to results (a row for each observation and channel) and hits.

Bodies are joined to the distinct ways in which they are observed (content type, kind, ending of the URL, resource
type), so a body served at many addresses is read and decoded once; what is found is joined back to the observations by
those narrow columns. One row goes through those joins for each way and each observation: the channels that apply, the
hits and the errors are arrays in it, and rows for each channel or hit are only made after them. Header channels are
Columns over the observations alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.grammar import DEFAULT, Grammar
from gleaner.operators.channels import Artifact
from gleaner.operators.registry import Registry, default_registry
from gleaner.runtime import discard, prepare, settle

SEEN_AS = ["sha256", "mime_type", "kind", "ending", "resource_type"]
HIT = ["extractor_ord", "hit_ord", "token", "method"]
FOUND = "array<struct<extractor_ord:int,hit_ord:long,token:string,method:string>>"
HEAD = "array<struct<extractor_ord:int,hit_ord:long,token:string,method:string,context:string>>"
#: What body_pass gives for each way. Contexts stand beside the hits, so that who doesn't want them doesn't shuffle them.
PASSED = f"{', '.join(f'{c} string' for c in SEEN_AS)}, applied array<int>, found {FOUND}, contexts array<string>, failed array<struct<extractor_ord:int,error:string>>"
#: Cookies look at headers and at bodies: hits of headers come first.
OF_BODY = 1 << 48


def ending() -> Column:
    """What body channels ask of a URL: its last characters from a dot on."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"\.[A-Za-z0-9]{1,12}$", 0))


def body_pass(registry: Registry, grammar: Grammar):
    """From (sha256, mime_type, kind, ending, resource_type, body) to a row of PASSED."""
    hit = pa.struct([("extractor_ord", pa.int32()), ("hit_ord", pa.int64()), ("token", pa.string()), ("method", pa.string())])
    failure = pa.struct([("extractor_ord", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some, outs = batch.slice(at, 64), []
                for r in some.to_pylist():
                    outs.append(registry.run(Artifact(r["mime_type"] or "", r["kind"] or "", r["ending"], r["resource_type"] or "", r["body"]), grammar))
                hits = [[(o.ord, h[0] + (OF_BODY if o.extractor == "cookies" else 0), *h[1:]) for o in done for h in o.hits] for done in outs]
                values = [
                    pa.array([[o.ord for o in done if o.applied] for done in outs], pa.list_(pa.int32())), pa.array([[dict(zip(HIT, h[:4], strict=True)) for h in own] for own in hits], pa.list_(hit)),
                    pa.array([[h[4] for h in own] for own in hits], pa.list_(pa.string())), pa.array([[{"extractor_ord": o.ord, "error": o.error} for o in done if o.error is not None] for done in outs], pa.list_(failure)),
                ]
                yield pa.RecordBatch.from_arrays([*some.select(SEEN_AS).columns, *values], names=[*SEEN_AS, "applied", "found", "contexts", "failed"])

    return run


def hits_of(ran: DataFrame, registry: Registry, *columns: str) -> DataFrame:
    """A row for each hit of rows that have found and contexts: columns, extractor_ord, hit_ord, token, method, context, extractor."""
    names = F.array(*(F.lit(i) for i in registry.ids)).cast("array<string>")
    each = ran.where(F.size("found") > 0).select(*columns, "contexts", F.posexplode("found").alias("at", "h"))
    return each.select(*columns, "h.*", F.get("contexts", F.col("at")).alias("context"), F.get(names, F.col("h.extractor_ord")).alias("extractor"))


def matches(texts: Column, grammar: Grammar) -> Column:
    """Hits of an array<struct<method, text>>, ordered by text and then place."""
    one = lambda t, i: F.transform(
        X.token_places(t["text"], grammar),
        lambda p: F.struct((F.shiftleft(i.cast("long"), 32) + p["at"] - 1).alias("hit_ord"), p["token"].alias("token"), t["method"].alias("method"), X.excerpt(t["text"], p["at"], F.length(p["token"])).alias("context")),
    )
    return F.flatten(F.transform(texts, one))


def header_texts(column: str, name: str) -> Column:
    entries = F.map_entries(F.coalesce(column, F.create_map().cast("map<string,string>")))
    return F.transform(entries, lambda e: F.struct(F.concat(F.lit(f"{name} header "), e["key"]).alias("method"), F.coalesce(e["value"], F.lit("")).alias("text")))


def header_channels() -> dict[str, tuple[Column, Column]]:
    """Of an observation and each header channel: whether it applies, and its texts."""
    headers, requests = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in ("headers", "request_headers"))
    status = F.struct(F.lit("status line").alias("method"), F.concat_ws(" ", F.col("status").cast("string"), F.coalesce("status_text", F.lit(""))).alias("text"))
    cookie = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "set-cookie")
    return {
        "response-headers": ((F.size(headers) > 0) | (F.length(F.coalesce("status_text", F.lit(""))) > 0), F.concat(F.array(status), header_texts("headers", "response"))),
        "request-headers": (F.size(requests) > 0, header_texts("request_headers", "request")),
        "cookies": (F.size(cookie) > 0, F.transform(cookie, lambda e: F.struct(F.lit("cookie that is set").alias("method"), F.coalesce(e["value"], F.lit("")).alias("text")))),
    }


def with_heads(observations: DataFrame, registry: Registry, grammar: Grammar) -> DataFrame:
    """Observations with what the header channels of the registry find: head (hits with their contexts), head_applied.
    No body is read. Headers count for cookies only where the registry looks for them in bodies."""
    own = [(registry.ids.index(k), *at) for k, at in header_channels().items() if k in (registry.body_ids if k == "cookies" else registry.ids)]
    hits = lambda k, t: F.transform(matches(t, grammar), lambda h: F.struct(F.lit(k).alias("extractor_ord"), *(h[c].alias(c) for c in (*HIT[1:], "context"))))
    found = [F.when(a, hits(k, t)).otherwise(F.array().cast(HEAD)).cast(HEAD) for k, a, t in own]
    ran = F.filter(F.array(*(F.when(a, F.lit(k)) for k, a, _ in own)).cast("array<int>"), lambda k: k.isNotNull())
    return observations.withColumns({"head": F.flatten(F.array(*found)) if found else F.array().cast(HEAD), "head_applied": ran})


class Extraction:
    """`runs`: a row for each readable observation with applied (channels by their place in the registry), found (hits),
    contexts (of those hits) and failed (errors); results and hits are views of it. `settled`: written tables that they read."""

    def __init__(self, runs: DataFrame, unreadable: DataFrame, registry: Registry, settled: tuple[DataFrame, ...] = ()):
        self.runs, self.unreadable, self.registry, self.settled = runs, unreadable, registry, settled

    @property
    def results(self) -> DataFrame:
        """A row for each observation and channel, and one for each observation that can't be read."""
        ids, heads = self.registry.ids, [k for k in header_channels() if k != "cookies"]
        channels = F.array(*(F.struct(F.lit(ids.index(k)).alias("ord"), F.lit(k).alias("id")) for k in [*self.registry.body_ids, *(k for k in heads if k in ids)])).cast("array<struct<ord:int,id:string>>")
        each, mine = self.runs.withColumn("c", F.explode(channels)), lambda x: x["extractor_ord"] == F.col("c.ord")
        own = each.select(
            "seq", "mime_type", F.col("body_path").alias("artifact_path"), F.col("c.ord").alias("extractor_ord"), F.col("c.id").alias("extractor"), F.array_contains("applied", F.col("c.ord")).alias("applied"),
            F.size(F.filter("found", mine)).cast("long").alias("n_hits"), F.get(F.filter("failed", mine), F.lit(0))["error"].alias("error"),
        )
        lost = self.unreadable.select("seq", "mime_type", F.col("body_path").alias("artifact_path"), F.lit(-1).alias("extractor_ord"), F.lit("(read)").alias("extractor"), F.lit(False).alias("applied"), F.lit(0).cast("long").alias("n_hits"), F.lit("body is missing").alias("error"))
        return own.unionByName(lost)

    @property
    def hits(self) -> DataFrame:
        """Every hit, repeats included."""
        ran = self.runs.select("seq", "source_url", F.col("body_path").alias("artifact_path"), "mime_type", "found", "contexts")
        return hits_of(ran, self.registry, "seq", "source_url", "artifact_path", "mime_type").select("seq", "extractor_ord", "hit_ord", "token", "source_url", "artifact_path", "extractor", "method", "context", "mime_type")


def extract(observations: DataFrame, bodies: DataFrame, registry: Registry | None = None, grammar: Grammar = DEFAULT, stepwise: bool = False) -> Extraction:
    """Runs the registry over every observation whose body is there; the others are `unreadable`.

    stepwise: the ways and what is found in bodies are written to the shared folder, each step's shuffle files going as
    it ends, so that the disk holds those of one step and not of all."""
    spark = prepare(observations.sparkSession)
    registry = registry or default_registry(prefix=grammar.prefix)
    source = F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))
    observations = observations.withColumns({"ending": ending(), "source_url": source})
    ways = observations.select(SEEN_AS).distinct()
    if stepwise:
        kept = ways = settle(ways, "ways", lean=True)
    # ways are dealt out by digest to a fixed number of tasks, and bodies meet them there: channels take far longer than
    # their bytes suggest, so few bytes are no reason to have few tasks
    dealt = ways.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sha256").hint("merge")
    met = dealt.join(bodies.dropDuplicates(["sha256"]), "sha256").select(*SEEN_AS, "body")
    if stepwise:
        passed = settle(met, "passed", body_pass(registry, grammar), PASSED, lean=True)
        discard(kept)
    else:
        passed = met.mapInArrow(body_pass(registry, grammar), PASSED)
    null_safe = [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in SEEN_AS]
    joined = with_heads(observations, registry, grammar).alias("o").join(passed.alias("p"), null_safe)
    plain = F.transform("o.head", lambda h: F.struct(*(h[c].alias(c) for c in HIT))).cast(FOUND)
    runs = joined.select(
        "o.seq", "o.mime_type", "o.body_path", "o.source_url", F.concat("o.head_applied", "p.applied").alias("applied"), F.concat(plain, "p.found").alias("found"),
        F.concat(F.transform("o.head", lambda h: h["context"]), "p.contexts").alias("contexts"), "p.failed",
    )
    return Extraction(runs, observations.join(bodies.select("sha256"), "sha256", "left_anti"), registry, (passed,) if stepwise else ())
