"""Streaming twins: tokens as artifacts arrive, the trap guard as keyed state, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.grammar import DEFAULT, Grammar
from gleaner.operators.extract import PASSED, body_pass, ending, hits_of
from gleaner.operators.registry import Registry, default_registry
from gleaner.plans.frontier import TrapRules
from gleaner.runtime import prepare


def token_stream(captures: DataFrame, registry: Registry | None = None, grammar: Grammar = DEFAULT, once: bool = True) -> DataFrame:
    """Tokens of a stream of captures (url, mime_type, kind, resource_type, body): token, extractor, method, mime_type.
    once: each token is reported the first time only; its state is one row for each token."""
    prepare(captures.sparkSession)
    registry = registry or default_registry(prefix=grammar.prefix)
    seen = captures.withColumns({"ending": ending(), "sha256": F.sha2("body", 256)}).select("sha256", "mime_type", "kind", "ending", "resource_type", "body")
    ran = seen.mapInArrow(body_pass(registry, grammar), PASSED)
    hits = hits_of(ran, registry, "sha256", "mime_type").select("token", "extractor", "method", "mime_type", "sha256")
    return hits.dropDuplicates(["token"]) if once else hits


def trap_stream(visits: DataFrame, rules: TrapRules = TrapRules()) -> DataFrame:
    """The trap guard over a stream of fetches (template, seq, shape, novelty): a row for each template at the fetch
    that closes it. State of a template: counts and at most `shapes` + 1 shapes, as more keep it open for good."""

    def guard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetched, novelty, closed, shapes = state.get if state.exists else (0, 0, False, [])
        known, out = set(shapes), []
        for pdf in batches:
            for seq, shape, new in pdf.sort_values("seq")[["seq", "shape", "novelty"]].itertuples(index=False):
                fetched, novelty = fetched + 1, novelty + int(new)
                if len(known) <= rules.shapes:
                    known.add(shape)
                if not closed and fetched >= rules.sample and len(known) <= rules.shapes and novelty == 0:
                    closed = True
                    out.append((key[0], int(seq), fetched, len(known)))
        state.update((fetched, novelty, closed, sorted(known)))
        yield pd.DataFrame(out, columns=["template", "seq", "fetched", "distinct_shapes"])

    return visits.groupBy("template").applyInPandasWithState(guard, "template string, seq long, fetched long, distinct_shapes long", "fetched long, novelty long, closed boolean, shapes array<string>", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows over event time, in batch or as a stream: events and their value by type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events less than `gap` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
