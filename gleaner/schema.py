"""Tables of the engine. Order columns carry what "first" means, since rows have no order of their own."""

from __future__ import annotations

from pyspark.sql import types as T

DISCOVERY = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "discovered_from", "detail")])
HEADERS = T.MapType(T.StringType(), T.StringType())

OBSERVATIONS = T.StructType(
    [
        T.StructField("sha256", T.StringType()), T.StructField("body_path", T.StringType()), T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("status_text", T.StringType()),
        T.StructField("method", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("mime_type", T.StringType()),
        T.StructField("byte_length", T.LongType()), T.StructField("headers", HEADERS), T.StructField("request_headers", HEADERS),
        T.StructField("resource_type", T.StringType()), T.StructField("from_cache", T.BooleanType()), T.StructField("fetched_at", T.StringType()),
        T.StructField("kind", T.StringType()), T.StructField("discovery", DISCOVERY), T.StructField("seq", T.LongType()),
    ]
)
BODIES = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("body", T.BinaryType())])
DISCOVERIES = T.StructType(
    [T.StructField("seq", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("key", "raw_url", "discovered_from", "source", "detail"))]
)
HITS = "seq long, extractor_ord int, hit_ord long, token string, source_url string, artifact_path string, extractor string, method string, context string, mime_type string"
RESULTS = "seq long, mime_type string, artifact_path string, extractor_ord int, extractor string, applied boolean, n_hits long, error string"

KINDS = ("response", "rendered-dom", "storage", "derived", "accessibility-text")
KIND_MEANING = {
    "response": "bytes of an HTTP response, documents and subresources alike",
    "rendered-dom": "the document after its scripts ran; not the same as the raw body",
    "storage": "cookies, local and session storage, generated content, hidden text",
    "derived": "made from another artifact",
    "accessibility-text": "text that only the accessibility tree has",
}

#: How hits in stored browser state name their method; in a cookie they only echo what a page shows.
STORED = "stored state:"
