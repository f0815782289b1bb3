"""Balanced contiguous shards from global byte prefix sums, with DataFrame functions only.

Documents are ordered by doc_id by a range exchange of narrow rows (id, size, checksum; never the text). Totals per
range partition, a few hundred rows, are summed up in order and joined back; inside a partition a window adds the
rest. The cut is by where a document starts: shard = start * shards / total, so shards hold equal bytes up to the
length of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.runtime import settle, table

SHARDS = 16


def shard(docs: DataFrame, shards: int = SHARDS, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, start_byte for each document.

    A null text counts one byte and has the checksum of the empty text. Rows with null doc_id come first; rows of equal
    doc_id follow the order in which the source is read, so each has a place of its own. A document longer than a
    shard's target leaves later shards' targets as they are, and a shard may then be empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("__tie"),
    )
    # the texts are read once; sampling for the ranges and both uses below read these narrow rows
    ranged = settle(narrow, "sizes").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("__tie"))
    rows = settle(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    totals = totals.select(
        "__part", F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__b0"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__r0"),
        F.sum("__bytes").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    inside = Window.partitionBy("__part").orderBy(F.col("doc_id").asc_nulls_first(), "__tie")
    sums = rows.withColumns({"__b": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "__r": F.row_number().over(inside) - 1})
    # totals have one row for each of n range partitions: the broadcast is bounded by the exchange's own width
    placed = sums.join(F.broadcast(totals), "__part").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), (F.col("__b0") + F.coalesce("__b", F.lit(0))).alias("start_byte"),
        (F.col("__r0") + F.col("__r")).cast("long").alias("__row"), "__total",
    ).withColumn("shard", F.expr(f"cast(least({shards - 1}, start_byte * {shards} div __total) as int)"))
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))  # as many rows as shards
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("__row") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "start_byte",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS r,
  xor(coalesce(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1]), 4294967295), 4294967295), 4294967295) AS text_crc32 FROM documents, tab),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM d),
p AS (SELECT *, CAST(least(15, s * 16 // (SELECT sum(size) FROM d)) AS INTEGER) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(s AS BIGINT) AS start_byte FROM p
"""
