"""A corpus pipeline of five stages: toxic documents go, one document of each near-duplicate group stays, contaminated
documents go, secrets are blotted out, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import chosenpath, decontam, packing, secrets, toxicity
from gleaner.runtime import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't reject. Null and empty texts have no words and stay; rows of null or equal doc_id
    are judged each by its text; an empty table gives no rows."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of smallest id (rows without an id come last), and of rows that are
    equal in id and set any one. Rows go, not ids: another text of the same id stays. Null and empty texts all stay."""
    return chosenpath.distinct(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts hold none and stay; an empty benchmark takes
    nothing; rows of null or equal doc_id are judged each by its text."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, secrets blotted out; n_chars follows the text, where there is such a column. Null texts stay null."""
    out = secrets.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document. A null or empty text is one piece, its end id; rows of null or equal
    doc_id are documents of their own; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", blot_secrets),
    ("packing", pack_sequences),
]
#: A learned lexicon, tokenising and packing have no form in SQL; the tests check stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
