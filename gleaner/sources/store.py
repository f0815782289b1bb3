"""The artifact store: observations and bodies as tables, written once each, and the on-disk form with a JSON index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import text as X
from gleaner.functions import url as U
from gleaner.schema import BODIES, OBSERVATIONS

KEY = ["kind", "url", "sha256", "status"]

#: Names of the index's fields, which are in camel case, and of the columns.
FIELDS = {
    "sha256": "sha256", "bodyPath": "body_path", "url": "url", "finalUrl": "final_url", "status": "status", "statusText": "status_text",
    "method": "method", "contentType": "content_type", "mimeType": "mime_type", "byteLength": "byte_length", "headers": "headers",
    "requestHeaders": "request_headers", "resourceType": "resource_type", "fromCache": "from_cache", "fetchedAt": "fetched_at", "kind": "kind",
}


def observe(captured: DataFrame) -> DataFrame:
    """Fills in what follows from a capture (url, body and whatever columns it has): digest, path, size, content type,
    defaults. Needs seq, the order of capture."""
    defaults = {
        "final_url": F.col("url"), "status": F.lit(200), "status_text": F.lit("OK"), "method": F.lit("GET"), "content_type": F.lit("application/octet-stream"),
        "headers": F.create_map().cast("map<string,string>"), "request_headers": F.create_map().cast("map<string,string>"), "resource_type": F.lit("other"),
        "from_cache": F.lit(False), "fetched_at": F.lit("1970-01-01T00:00:00.000Z"), "kind": F.lit("response"), "discovery": F.lit(None),
    }
    out = captured.withColumns({k: v for k, v in defaults.items() if k not in captured.columns})
    if "mime_type" not in captured.columns:
        out = out.withColumn("mime_type", X.mime_of("content_type"))
    out = out.withColumn("sha256", F.sha2("body", 256)).withColumn("byte_length", F.length("body").cast("long"))
    out = out.withColumn("body_path", X.body_path("sha256", "mime_type", F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))))
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATIONS), "body")


def recover_empty(observations: DataFrame) -> DataFrame:
    """Observations, those without a body that should have had one linked to the first other capture of their URL that has one.

    A row that has no such capture stays as it is, and so do responses that have no body by their nature. Null URLs have
    no other capture. An empty table gives no rows."""
    lost = (F.col("byte_length") == 0) & (F.col("kind") == "response") & X.should_have_body("status", "method", F.lit(None).cast("string"))
    other = observations.where("byte_length > 0 and kind = 'response'").groupBy("url").agg(F.min_by(F.struct("sha256", "body_path", "byte_length"), "seq").alias("__other"))
    use = lost & F.col("__other").isNotNull()
    return observations.join(other, "url", "left").withColumns({c: F.when(use, F.col(f"__other.{c}")).otherwise(F.col(c)) for c in ("sha256", "body_path", "byte_length")}).select(observations.columns)


def split(captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, bodies) of captures: each observation and each body once."""
    full = observe(captured)
    w = Window.partitionBy(*KEY).orderBy("seq")
    first = full.drop("body").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first, full.select("sha256", "body").dropDuplicates(["sha256"])


class Store:
    """Tables `observations` and `bodies` under a path that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def observations(self) -> DataFrame:
        return self._read("observations", OBSERVATIONS)

    @property
    def bodies(self) -> DataFrame:
        return self._read("bodies", BODIES)

    def put(self, captured: DataFrame) -> tuple[int, int]:
        """Adds what isn't there yet; (new observations, new bodies). Doing it again adds nothing. Bodies are spread by
        the first two digits of their digest, as on disk. Bodies are written first, so a put that breaks off leaves bodies
        without observations, which the next one finds."""
        first, bodies = split(captured)
        new = first.join(self.observations.select(KEY), KEY, "left_anti").cache()
        fresh = bodies.join(self.bodies.select("sha256"), "sha256", "left_anti").cache()
        counts = new.count(), fresh.count()
        fresh.write.mode("append").parquet(f"{self.path}/bodies")
        new.write.mode("append").parquet(f"{self.path}/observations")
        for df in (new, fresh):
            df.unpersist()
        return counts

    def keep(self, **tables: DataFrame) -> None:
        """Writes tables of a crawl beside the artifacts, in place of those of the crawl before."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def kept(self, name: str) -> DataFrame | None:
        """A table that keep() has written; None if there is none."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        there = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.parquet(f"{self.path}/{name}") if there else None

    def unique_bodies(self) -> int:
        return self.bodies.select("sha256").distinct().count()

    def captured_urls(self) -> DataFrame:
        """What a resumed crawl needn't fetch again: responses below 400."""
        return self.observations.where("kind = 'response' and status < 400").select("url").distinct()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Observations of an on-disk index of JSON lines, in order. Blank lines are passed over; a broken one fails."""
    from pyspark.sql import types as T

    types = {f.name: f.dataType for f in OBSERVATIONS}
    schema = T.StructType([T.StructField(k, types[v]) for k, v in FIELDS.items()] + [T.StructField("discovery", T.StructType([T.StructField(n, T.StringType()) for n in ("source", "discoveredFrom", "detail")]))])
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    d = F.when(F.col("discovery").isNotNull(), F.struct(F.col("discovery.source").alias("source"), F.col("discovery.discoveredFrom").alias("discovered_from"), F.col("discovery.detail").alias("detail")))
    return raw.withColumn("discovery", d).withColumnsRenamed(FIELDS).withColumn("seq", F.monotonically_increasing_id()).select(OBSERVATIONS.names)


def read_bodies(spark: SparkSession, root: str) -> DataFrame:
    """Bodies of an on-disk store, by the digest in their file names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/bodies")
    return files.select(F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1).alias("sha256"), F.col("content").alias("body")).dropDuplicates(["sha256"])


def write_index(observations: DataFrame, path: str) -> None:
    back = {v: k for k, v in FIELDS.items()}
    observations.orderBy("seq").withColumn("discovery", F.when(F.col("discovery").isNotNull(), F.struct(F.col("discovery.source").alias("source"), F.col("discovery.discovered_from").alias("discoveredFrom"), F.col("discovery.detail").alias("detail")))).withColumnsRenamed(back).drop("seq").write.json(path)


def of_host(captured: DataFrame, host: str) -> DataFrame:
    """The captures whose URL is of that host (with its port); null and broken URLs are of none."""
    return captured.where(U.same_host(F.col("url"), F.lit(host)))


def rendered_dom(pages: DataFrame) -> DataFrame:
    """Captures of documents as they were after their scripts ran (url, html, seq), beside the responses of the same URL.
    Pages without a document (null) give none."""
    return pages.where("html is not null").select("url", F.encode("html", "UTF-8").alias("body"), F.lit("text/html").alias("content_type"), F.lit("rendered-dom").alias("kind"), F.lit("document").alias("resource_type"), "seq")


def browser_state(pages: DataFrame) -> DataFrame:
    """Sidecar captures of a page's state: url (cookies, storages, generated content, all and visible text as columns or
    null) to a JSON body at `url#browser-state`."""
    columns = [c for c in ("cookies", "local_storage", "session_storage", "pseudo_content", "all_text", "visible_text") if c in pages.columns]
    hidden = [X.hidden_text(F.coalesce("all_text", F.lit("")), F.coalesce("visible_text", F.lit(""))).alias("nonVisibleText")] if {"all_text", "visible_text"} <= set(columns) else []
    return pages.select(F.concat("url", F.lit("#browser-state")).alias("url"), F.encode(F.to_json(F.struct(*columns, *hidden)), "UTF-8").alias("body"), F.lit("application/json").alias("content_type"), F.lit("storage").alias("kind"), F.lit("browser-state").alias("resource_type"), "seq")


def cookie_jar(cookies: DataFrame) -> DataFrame:
    """Captures of cookies (url, seq, cookies as an array of structs) at `url#cookies`."""
    return cookies.select(F.concat("url", F.lit("#cookies")).alias("url"), F.encode(F.to_json("cookies"), "UTF-8").alias("body"), F.lit("application/json").alias("content_type"), F.lit("storage").alias("kind"), F.lit("cookies").alias("resource_type"), "seq")
