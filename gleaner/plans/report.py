"""Reports: the nested JSON of tokens, the Markdown report and the inventory. Everything is aggregated before it comes to
the driver; long tables are shown by their first rows."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import TextIO

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gleaner.functions.text import short
from gleaner.operators import relational as R
from gleaner.operators.extract import Extraction
from gleaner.operators.registry import Registry
from gleaner.plans.frontier import Crawl
from gleaner.runtime import discard, settle

#: Rows of long tables that a report shows; the tables themselves are written beside it.
TEMPLATES, ERRORS, URLS, TOKENS, FORMS = 40, 100, 1000, 1000, 100


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def tokens_table(hits: DataFrame, registry: Registry) -> DataFrame:
    """A row for each token: its best hit and, nested, every other one in order."""
    best = R.best_hits(hits, registry)
    rest = R.also_seen_in(hits, registry).groupBy("token").agg(F.array_sort(F.collect_list(F.struct(*R.ORDER, F.col("source_url").alias("sourceUrl"), "extractor", "method"))).alias("rest"))
    also = F.transform(F.coalesce("rest", F.array().cast("array<struct<seq:bigint,extractor_ord:int,hit_ord:bigint,sourceUrl:string,extractor:string,method:string>>")), lambda x: F.struct(x["sourceUrl"].alias("sourceUrl"), x["extractor"].alias("extractor"), x["method"].alias("method")))
    return best.join(rest, "token", "left").select("token", F.col("source_url").alias("sourceUrl"), F.col("artifact_path").alias("artifactPath"), "extractor", "method", "context", F.col("mime_type").alias("mimeType"), also.alias("alsoSeenIn")).orderBy("token")


def write_tokens(to: TextIO, hits: DataFrame, registry: Registry, base_url: str, generated: str | None = None) -> None:
    """The whole JSON file, a token at a time: neither a task nor the driver holds all of them."""
    tokens = settle(tokens_table(hits, registry).select(F.to_json(F.struct("*")).alias("value"), "token"), "tokens")
    head = json.dumps({"generatedAt": generated or now(), "baseUrl": base_url, "count": tokens.count()}, indent=2, ensure_ascii=False)
    to.write(head[:-2] + ',\n  "tokens": [')
    for i, r in enumerate(tokens.orderBy("token").toLocalIterator()):
        to.write(("," if i else "") + "\n    " + r.value)
    to.write("\n  ]\n}\n")
    discard(tokens)


def pipes(text: str | None) -> str:
    return (text or "").replace("|", "\\|").replace("\n", " ")


def grid(head: list[str], rows: list, right: tuple[int, ...] = ()) -> list[str]:
    return ["| " + " | ".join(head) + " |", "| " + " | ".join("---:" if i in right else "---" for i in range(len(head))) + " |", *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]


def frontier_section(crawl: Crawl | None) -> list[str]:
    if crawl is None:
        return ["_No crawl in this run; what follows describes the stored artifacts._", ""]
    s: Row = crawl.stats.first()
    out = [
        f"- URLs known (canonical, each once): **{s.known}**", f"- URLs visited: **{s.visited}**",
        f"- URLs pending at the end: **{s.pending}** " + ("(frontier exhausted)" if s.pending == 0 else "(stopped before the end)"),
        f"- Discoveries, repeats included: {s.discoveries}", f"- Off-host links passed over: {s.off_host}", f"- Unusable links passed over: {s.unusable}",
        f"- URLs refused by the trap guard: {s.trapped}", "",
    ]
    sources = R.count_by(crawl.discoveries, "source", "seq").collect()
    out += ["### Discovery sources", "", *grid(["Source", "Discoveries"], [(f"`{r.source}`", r["count"]) for r in sources], (1,))]
    shown = crawl.templates.orderBy(F.desc("enqueued"), "template").limit(TEMPLATES).collect()
    rows = [(f"`{r.template}`", r.enqueued, r.fetched, r.distinct_shapes, r.outbound_novelty, f"yes — {pipes(r.reason)}" if r.saturated else "no") for r in shown]
    out += ["### URL templates", "", *grid(["Template", "Enqueued", "Fetched", "Distinct shapes", "Outbound novelty", "Saturated"], rows, (1, 2, 3, 4))]
    closed = crawl.templates.where("saturated").count()
    if closed:
        out += [f"**{closed} template(s) were closed by the trap guard.**", ""]
    urls = R.first_rows(R.url_inventory(crawl.discoveries).select("seq", "key", "sources", short("first_seen_on").alias("on")), URLS + 1, "seq").collect()
    rows = [(i + 1, f"`{r.key}`", ", ".join(f"`{x}`" for x in r.sources.split(", ")), f"`{r.on}`") for i, r in enumerate(urls[:URLS])]
    return [*out, "### URL inventory", "", *grid(["#", "URL", "Discovered via", "First seen on"], rows, (0,)), *cut(urls, URLS, "url-inventory")]


def cut(rows: list, most: int, name: str) -> list[str]:
    return [f"_The first {most} rows; all are in the table `{name}`._", ""] if len(rows) > most else []


def forms_section(forms: DataFrame | None) -> list[str]:
    """Forms that were seen and not sent, in order; a limited number."""
    rows = [] if forms is None else R.first_rows(forms, FORMS + 1, "page", "ord").collect()
    if not rows:
        return []
    return ["### Forms that were not sent", "", *grid(["Page", "Method", "Action"], [(f"`{pipes(r.page)}`", r.method, f"`{pipes(r.action)}`") for r in rows[:FORMS]]), *cut(rows, FORMS, "forms")]


def artifact_section(observations: DataFrame) -> list[str]:
    s = R.dedupe_stats(observations).first()
    out = [f"- Observations: **{s.observations}**", f"- Distinct bodies: **{s.bodies}**", f"- Bodies saved: **{s.collapsed}** ({s.share} of observations)", "", "### By content type", ""]
    out += grid(["Content type", "Observations", "Distinct bodies", "Bytes"], [(f"`{r.mime_type}`", r.observations, r.bodies, f"{r.bytes:,}") for r in R.by_mime(observations).collect()], (1, 2, 3))
    out += ["### By kind", "", *grid(["Kind", "Count", "Meaning"], [(f"`{r.kind}`", r["count"], r.meaning) for r in R.by_kind(observations).collect()], (1,))]
    return [*out, "### By status", "", *grid(["Status", "Count"], [(r.status, r["count"]) for r in R.count_by(observations, "status", "seq").collect()], (0, 1))]


def render(base_url: str, observations: DataFrame, extraction: Extraction, registry: Registry, crawl: Crawl | None = None, generated: str | None = None, forms: DataFrame | None = None) -> str:
    runs = settle(extraction.runs, "runs")  # the bodies are read once
    extraction = Extraction(runs, extraction.unreadable, registry)
    results, hits = extraction.results, settle(R.dedupe_hits(extraction.hits), "hits")
    ranked = R.best_hits(hits, registry).select("token", short("source_url").alias("at"), "method", "extractor")
    best, distinct = R.first_rows(ranked, TOKENS + 1, "token").collect(), R.unique_tokens(hits).count()
    out = ["# Crawl report", "", f"- Base URL: `{base_url}`", f"- Generated: {generated or now()}", f"- Distinct tokens: **{distinct}**", "", "## 1. Frontier", "", *frontier_section(crawl), *forms_section(forms)]
    out += ["## 2. Artifacts", "", *artifact_section(observations), "## 3. Coverage", "", "Content types by channels: artifacts it ran over / tokens it found; — where it never applied.", ""]
    matrix = R.coverage_matrix(results, registry).collect()
    out += grid(["Content type", *(f"`{i}`" for i in registry.ids)], [(f"`{r.mime_type}`", *(r[i] for i in registry.ids)) for r in matrix])
    silent = R.without_hits(results, registry).collect()
    out += ["### Channels that found nothing", "", *([f"- `{r.extractor}` — {r.description}" for r in silent] or ["_None; every channel found something._"]), "", "## 4. Tokens", ""]
    out += grid(["#", "Token", "Where", "How"], [(i + 1, f"`{r.token}`", f"`{r.at}`", f"{pipes(r.method)} (`{r.extractor}`)") for i, r in enumerate(best[:TOKENS])], (0,)) + cut(best, TOKENS, "tokens") if best else ["_None found._", ""]
    errors = results.where("error is not null").orderBy("seq", "extractor_ord").limit(ERRORS).collect()
    if errors:
        out += ["## 5. Errors", "", *grid(["Artifact", "Channel", "Message"], [(f"`{r.artifact_path}`", f"`{r.extractor}`", pipes(r.error)) for r in errors])]
    discard(runs, hits)
    return "\n".join(out)


def exit_code(found: int, wanted: int = 8) -> int:
    """0: all tokens that were looked for; 2: some; 1: none."""
    return 0 if found == wanted else 2 if found else 1
