"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding undoes case, accents, homoglyphs and digit or sign substitutions and leaves words set apart by single spaces.
The lexicon holds whole words and word stems, weighted by their log odds in labelled documents; a word counts once,
by its heaviest entry, and not at all inside an exception phrase. The sum, as it is and over the length in words, gives
a probability by logistic regression. Lexicon and regression are fitted on a bounded sample of labelled rows outside
the held-out quarter; every document is scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.runtime import discard, prepare, settle, table

#: Labelled rows that lexicon and regression are fitted on at most. That bounds the lexicon too.
SAMPLE = 10_000
#: Labelled documents that an entry must occur in, and its least log odds; lengths of stems.
SUPPORT, ODDS, STEMS = 3, 2.0, (4, 5, 6)
THRESHOLD = 0.3
#: Harmless uses of words that may be in the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "class clown", "loser bracket", "pond scum", "hate to say", "kill time", "kill switch")

# Letters that look like Latin ones, and what stands in for letters.
LOOKALIKES = dict(zip("аеорсухкмтнвіјѕԁӏոԛԝɑɡɩοαεικνρτυχϲ", "aeopcyxkmthbijsdlnqwagioaeiknptuxc", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
INNER = re.compile(r"(?<=\w)[@$!|](?=\w)|(?<!\S)[@$](?=\w)")


class Fold(dict):
    """Code point to its folded form, made as it is needed."""

    def __missing__(self, point: int) -> str:
        c = chr(point).lower()
        c = "".join(LOOKALIKES.get(x, DIGITS.get(x, x)) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x) and unicodedata.category(x) != "Cf")
        c = "".join(x if x.isalnum() else " " for x in c)
        if len(self) < 100_000:
            self[point] = c
        return c


FOLD = Fold()


def fold(text: str) -> str:
    """The folded text, with one space before and after each word."""
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = INNER.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(FOLD).split())} "


def entries(word: str) -> list[str]:
    """What of a word may be in the lexicon: ' word ' and ' stem'."""
    return [f" {word} ", *(f" {word[:k]}" for k in STEMS if len(word) > k)]


def count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, toxic) to (entry, toxic, documents), added up over some hundreds of documents."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            found: Counter = Counter()
            for text, y in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                found.update((e, y) for e in {e for w in set(fold(text or "").split()) for e in entries(w)})
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["entry", "toxic", "docs"])


class Matcher:
    """The lexicon as an automaton. An exception phrase of one word goes before a lexicon entry that is the same."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        phrases = [f" {fold(e).strip()} " for e in exceptions]
        for e, w in {**lexicon, **dict.fromkeys(phrases, 0.0)}.items():
            self.automaton.add_word(e, (len(e), w))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, float]:
        """(weight of the words found, words found, words)."""
        folded = fold(text)
        best: dict[int, float] = {}
        except_: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded) if self.some else ():
            start = end - size + 1
            if weight == 0.0:
                except_.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in except_:
            for s in [s for s in best if a <= s < b]:
                del best[s]
        return sum(best.values()), float(len(best)), float(folded.count(" ") - 1 if folded.strip() else 0)


_matchers: dict[int, Matcher] = {}


def matcher(lexicon: dict[str, float], exceptions: tuple[str, ...]) -> Matcher:
    key = hash((tuple(lexicon.items()), exceptions))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(lexicon, exceptions)
    return _matchers[key]


def vector(rows: np.ndarray) -> np.ndarray:
    """What the regression sees of (weight, found, words)."""
    weight, found, words = rows.T
    return np.stack([np.ones(len(rows)), found > 0, np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1)), np.log1p(found)], axis=1)


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...], weights: np.ndarray):
        self.lexicon, self.exceptions, self.weights = lexicon, exceptions, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = matcher(self.lexicon, self.exceptions)
        rows = np.array([m.features(t or "") for t in texts], float).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(vector(rows) @ self.weights, -30, 30)))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from at most `sample` labelled rows outside the held-out quarter (those of smallest id hash). Rows with
    null id, label or document are passed over; of several labels for an id the largest counts. Without any labelled
    row all scores are alike and below the threshold."""
    prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    # the sample's bound is the bound of what is broadcast
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = settle(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"), "labelled")
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = seen.get(1, 0), sum(n for y, n in seen.items() if y != 1)
    counts = rows.mapInArrow(count_entries, "entry string, toxic int, docs long").groupBy("entry").agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("docs"))), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(F.col("toxic") != 1, F.col("docs"))), F.lit(0)).alias("g"))
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    chosen = counts.withColumn("w", odds).where((F.col("b") >= SUPPORT) & (F.col("w") >= ODDS)).orderBy("entry").collect()
    lexicon = {r["entry"]: float(r["w"]) for r in chosen}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matcher(lexicon, exceptions)
            found = np.array([m.features(t or "") for t in batch.column(0).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found.T), batch.column(1)], names=["weight", "found", "words", "toxic"])

    got = np.array([tuple(r) for r in rows.mapInArrow(features, "weight double, found double, words double, toxic int").collect()], float).reshape(-1, 4)
    got = got[np.lexsort(got.T)]
    discard(rows)
    y = (got[:, 3] == 1).astype(float)
    weights = regress(vector(got[:, :3]), y) if len(got) and 0 < y.sum() < len(y) else np.array([math.log(0.05), 0, 0, 0, 0])
    return Model(lexicon, exceptions, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each document.

    A null or empty text has no words and the score of none found. A null doc_id isn't held out. Rows of equal doc_id
    are scored each; an empty table gives no rows; extra columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(model.scores(some.column(2).to_pylist()))], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """Documents whose score is below the threshold; all columns stay.

    Null and empty texts have no words, and the score of none found, which is below it. Rows of null or equal doc_id are
    judged each by its text; an empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                yield some.filter(pa.array(model.scores(some.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
