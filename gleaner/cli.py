"""python -m gleaner.cli [crawl|extract|report|run]: crawl stored pages, extract tokens, write the reports.

Exit status: 0 if all tokens looked for were found, 2 if some, 1 if none."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as X
from gleaner.functions.url import host_of
from gleaner.grammar import Grammar
from gleaner.operators import relational as R
from gleaner.operators.discover import posted_forms, written_links
from gleaner.operators.extract import Extraction, extract
from gleaner.operators.registry import default_registry
from gleaner.plans import report
from gleaner.plans.frontier import Crawl, crawl
from gleaner.runtime import session, settle
from gleaner.sources.store import Store, recover_empty

COMMANDS = ("crawl", "extract", "report", "run")


def pages_of(store: Store):
    """Pages among the stored responses, as the source of a crawl."""
    own = store.observations.where(X.is_renderable("mime_type") & X.is_navigable("url"))
    return own.join(store.bodies, "sha256").select("url", F.make_valid_utf8(F.col("body").cast("string")).alias("html"))


TABLES = ("frontier", "discoveries", "templates", "skipped", "pending")


def harvested(store: Store, conf: config.Config, log: config.Logger) -> Crawl:
    """A crawl of the stored pages, its tables written to the store."""
    more = written_links(store.observations.where("kind in ('response', 'storage')"), store.bodies)
    done = crawl(pages_of(store), [conf.base_url], host=host_of(conf.base_url), max_pages=conf.max_pages, more=more, log=lambda **n: log.log("info", "level", **n))
    store.keep(**{f"crawl-{name}": getattr(done, name) for name in TABLES})
    return earlier(store)


def earlier(store: Store) -> Crawl | None:
    """The crawl that the store has; None before the first one."""
    tables = [store.kept(f"crawl-{name}") for name in TABLES]
    return None if any(t is None for t in tables) else Crawl(*tables)


def main(args: list[str]) -> int:
    command = args[0] if args else "run"
    if command not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 1
    conf = config.load()
    log = config.Logger(conf.log_level, command=command)
    spark = session()
    store, grammar = Store(spark, conf.store), Grammar(conf.token_prefix)
    log.log("info", "start", store=conf.store)
    harvest = harvested(store, conf, log) if command in ("crawl", "run") else earlier(store)
    if command == "crawl":
        for r in R.inventory(store.observations).collect():
            print(f"{r.mime_type:40} {r['count']:>8,} {r.bytes:>14,}")
        log.log("info", "crawled", **harvest.stats.first().asDict())
        return 0
    registry = default_registry(prefix=grammar.prefix)
    observations = recover_empty(store.observations)
    found = extract(observations, store.bodies, registry, grammar)
    runs = settle(found.runs, "runs")
    found = Extraction(runs, found.unreadable, registry)
    hits = settle(R.dedupe_hits(found.hits), "hits")
    for r in R.running_tokens(hits).orderBy("known").toLocalIterator():
        print(f"[{r.known}] {r.token}  {r.source_url}  ({r.extractor})")
    out = Path(conf.out)
    out.mkdir(parents=True, exist_ok=True)
    with (out / "tokens.json").open("w", encoding="utf-8") as f:
        report.write_tokens(f, hits, registry, conf.base_url)
    forms = posted_forms(pages_of(store))
    (out / "crawl-report.md").write_text(report.render(conf.base_url, observations, found, registry, harvest, forms=forms), encoding="utf-8")
    store.keep(tokens=report.tokens_table(hits, registry), forms=forms)
    if harvest is not None:
        store.keep(**{"url-inventory": R.url_inventory(harvest.discoveries)})
    return report.exit_code(R.unique_tokens(hits).count())


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
