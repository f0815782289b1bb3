"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import chosenpath, decontam, gif, packing, secrets, seedextend, sharding, suffixdedup, tokenfile, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontam.query,
    "op2_sharding": sharding.query,
    "op3_substring_dedup": seedextend.query,
    "op4_secrets": secrets.query,
    "op5_packing": packing.query,
    "op6_near_dedup": chosenpath.query,
    "op7_token_files": tokenfile.query,
    "op8_suffix_dedup": suffixdedup.query,
    "op9_gif": gif.query,
    "op10_toxicity": toxicity.query,
    # what SQL can say of two operators that it can't express as a whole
    "secret_base_spans": secrets.base_query,
    "gif_payloads": gif.payload_query,
}
SQL: dict[str, str] = {
    "op1_decontamination": decontam.SQL,
    "op2_sharding": sharding.SQL,
    "op3_substring_dedup": seedextend.SQL,
    "op6_near_dedup": chosenpath.SQL,
    "op8_suffix_dedup": suffixdedup.SQL,
    "secret_base_spans": secrets.SQL,
    "gif_payloads": gif.SQL,
}
