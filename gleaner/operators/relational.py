"""What is asked of hits, results, observations and discoveries. Plain DataFrames; order columns say what comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators.registry import Registry
from gleaner.runtime import settle
from gleaner.schema import KIND_MEANING, STORED

ORDER = ["seq", "extractor_ord", "hit_ord"]


def first_of(hits: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key. An aggregate, so rows of a hot key are combined before the shuffle."""
    rest = [c for c in hits.columns if c not in keys]
    return hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")).select(*keys, "__first.*").select(*hits.columns)


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each token, source and method."""
    return first_of(hits, ["token", "source_url", "method"], *ORDER)


def specificity(registry: Registry, unknown: int = 5) -> Column:
    """How well the channel of a hit explains it; a cookie hit that only echoes a page's text explains little."""
    ranks = F.create_map(*(F.lit(x) for c in registry.channels for x in (c.id, c.rank)))
    echo = (F.col("extractor") == "cookies") & F.col("method").startswith(STORED)
    return F.when(echo, 1).otherwise(F.coalesce(F.try_element_at(ranks, F.col("extractor")), F.lit(unknown)))


def best_hits(hits: DataFrame, registry: Registry) -> DataFrame:
    """The most telling hit of each token, the first of equals; sorted by token."""
    return first_of(hits.withColumn("rank", specificity(registry)), ["token"], (-F.col("rank")).alias("__rank"), *ORDER).orderBy("token")


def also_seen_in(hits: DataFrame, registry: Registry) -> DataFrame:
    """Every hit of a token but its best one."""
    return hits.join(best_hits(hits, registry).select(*ORDER, "token"), [*ORDER, "token"], "left_anti")


def coverage(results: DataFrame) -> DataFrame:
    """applied, hits and errors of each content type and channel; before hits are deduplicated. An error of a channel
    that didn't apply isn't counted."""
    ran = F.col("applied")
    return results.where("extractor_ord >= 0").groupBy("mime_type", "extractor").agg(
        F.count_if(ran).alias("applied"), F.sum(F.when(ran, F.col("n_hits")).otherwise(0)).alias("hits"), F.count_if(ran & F.col("error").isNotNull()).alias("errors")
    )


def coverage_matrix(results: DataFrame, registry: Registry) -> DataFrame:
    """A row for each content type, a column for each channel: applied/hits, with errors marked."""
    cell = F.when(F.col("applied") == 0, "—").otherwise(F.concat(F.col("applied").cast("string"), F.lit("/"), F.col("hits").cast("string"), F.when(F.col("errors") > 0, F.concat(F.lit(" ⚠"), F.col("errors").cast("string"))).otherwise("")))
    wide = coverage(results).withColumn("cell", cell).groupBy("mime_type").pivot("extractor", registry.ids).agg(F.first("cell"))
    return wide.na.fill("—").orderBy("mime_type")


def without_hits(results: DataFrame, registry: Registry) -> DataFrame:
    """Channels of the registry, in order, that found nothing."""
    spark = results.sparkSession
    every = spark.createDataFrame([(k, c.id, c.description) for k, c in enumerate(registry.channels)], "extractor_ord int, extractor string, description string")
    return every.join(results.where("n_hits > 0").select("extractor").distinct(), "extractor", "left_anti").orderBy("extractor_ord")


def unique_tokens(hits: DataFrame) -> DataFrame:
    return hits.select("token").distinct().orderBy("token")


def running_tokens(hits: DataFrame) -> DataFrame:
    """The first hit of each token, in order, with how many tokens were known by then: a distributed sort, and the
    number of rows of the range partitions before one's own, of which there is a row each."""
    first = settle(first_of(hits, ["token"], *ORDER).orderBy(*ORDER).withColumn("__id", F.monotonically_increasing_id()), "first-hits")
    part = F.shiftright("__id", 33).alias("__part")
    before = first.groupBy(part).agg(F.count("*").alias("n")).select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    known = F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1
    return first.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("known", known).drop("__id", "__part", "__before")


def hits_by_channel(hits: DataFrame) -> DataFrame:
    """Hits of each channel, most first."""
    return hits.groupBy("extractor").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "extractor")


def totals(observations: DataFrame, extraction_unreadable: DataFrame) -> DataFrame:
    """Artifacts scanned, and distinct bodies among those that could be read."""
    lost = extraction_unreadable.select("seq")
    return observations.agg(F.count("*").alias("artifacts")).crossJoin(observations.join(lost, "seq", "left_anti").agg(F.countDistinct("sha256").alias("bodies")))


def count_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each value, most first, then in order of first appearance."""
    return df.groupBy(key).agg(F.count("*").alias("count"), F.min(order).alias("__first")).orderBy(F.desc("count"), "__first").drop("__first")


def by_mime(observations: DataFrame) -> DataFrame:
    out = observations.groupBy("mime_type").agg(F.count("*").alias("observations"), F.countDistinct("sha256").alias("bodies"), F.sum("byte_length").alias("bytes"), F.min("seq").alias("__first"))
    return out.orderBy(F.desc("observations"), "__first").drop("__first")


def by_kind(observations: DataFrame) -> DataFrame:
    meaning = F.create_map(*(F.lit(x) for kv in KIND_MEANING.items() for x in kv))
    return count_by(observations, "kind", "seq").withColumn("meaning", F.coalesce(F.try_element_at(meaning, F.col("kind")), F.lit("")))


def dedupe_stats(observations: DataFrame) -> DataFrame:
    from gleaner.functions.text import percent

    s = observations.agg(F.count("*").alias("observations"), F.countDistinct("sha256").alias("bodies"))
    return s.withColumn("collapsed", F.col("observations") - F.col("bodies")).withColumn("share", percent("collapsed", "observations"))


def inventory(observations: DataFrame) -> DataFrame:
    """Count and bytes of each content type, and a row TOTAL."""
    return observations.rollup("mime_type").agg(F.grouping("mime_type").alias("g"), F.count("*").alias("count"), F.sum("byte_length").alias("bytes")).select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("mime_type")).alias("mime_type"), "count", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.col("g").alias("is_total")
    ).orderBy("is_total", F.desc("count"), "mime_type").drop("is_total")


def url_inventory(discoveries: DataFrame) -> DataFrame:
    """First discovery of each key with all its sources in the order they were met. A key met very often keeps one
    row for each source before the shuffle ends."""
    per_source = discoveries.groupBy("key", "source").agg(F.min("seq").alias("seq"), F.min_by("discovered_from", "seq").alias("discovered_from"), F.min_by("raw_url", "seq").alias("raw_url"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "source")))
    return per_source.groupBy("key").agg(F.min("seq").alias("seq"), F.min_by("discovered_from", "seq").alias("first_seen_on"), F.min_by("raw_url", "seq").alias("raw_url"), F.array_join(F.transform(ordered, lambda x: x["source"]), ", ").alias("sources"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
