"""Link discovery, the crawl's fixpoint, the trap guard, and their streaming twins."""

import re
from inspect import signature

import pytest
from pyspark.sql import functions as F

from gleaner.operators import discover
from gleaner.plans import frontier
from gleaner.plans.frontier import TrapRules, crawl, trap_states
from gleaner.sources import planted
from gleaner.streaming.streams import event_windows, token_stream, trap_stream

HTML = """<html><head><base href="/b/"><link rel=x href="s.css"><meta http-equiv="Refresh" content="0; url=/r"><style>@import "i.css"; p{background:url('bg.png')}</style></head>
<body><a href=" /a ">x</a><a href="#f">y</a><img src="i.png" srcset="j.png 1x, k.png 2x" data-src="l.png"><div data-x="/d/e" data-y="no" style="background:url(st.png)" onclick="go('/h')">z</div>
<script>var u = "/lit/x";</script><script src="q.js"></script><form action="/f?z=1"><input name=a value=1><input type=checkbox name=b><select name=s><option value=p><option value=q selected></select></form>
<form method=post action="/post"><input name=c></form><button role="button" formaction="/fa">B</button><svg><use href="u.svg"/></svg></body></html>"""


def test_candidates():
    got = [(u.strip(), s) for u, s, _ in discover.candidates(HTML)]
    for pair in (("/a", "anchor"), ("s.css", "link-rel"), ("/b/", "base"), ("i.png", "img"), ("l.png", "data-attribute"), ("j.png", "srcset"), ("k.png", "srcset"), ("/d/e", "data-attribute"), ("/r", "meta-refresh"), ("i.css", "css-import"), ("bg.png", "stylesheet-url"), ("st.png", "inline-style-url"), ("/h", "clickable-element"), ("/lit/x", "js-string-literal"), ("q.js", "script-src"), ("/f?a=1&s=q", "form-get"), ("/fa", "formaction"), ("u.svg", "svg-href")):
        assert pair in got
    assert not any(s == "form-get" and u.startswith("/post") for u, s in got)
    assert [c.split()[0] for c in discover.clickables(HTML)] == ["div", "button[role=button]"]


PAGES = [
    ("http://h.test/", '<a href="/b?utm_source=z">1</a><a href="/a">2</a><a href="http://other.test/">3</a><a href="mailto:x">4</a>'),
    ("http://h.test/a", '<a href="/c">1</a><a href="/b">2</a>'),
    ("http://h.test/b#x", '<a href="/c?ref=1">1</a><a href="/missing">1</a>'),
    ("http://h.test/c", None),
]


def test_fixpoint(spark):
    c = crawl(spark.createDataFrame(PAGES, "url string, html string"), ["http://h.test/"], host="h.test")
    rows = c.frontier.orderBy("seq").collect()
    assert [(r.url.removeprefix("http://h.test"), r.depth, r.visited) for r in rows] == [("/", 0, True), ("/b", 1, True), ("/a", 1, True), ("/c", 2, True), ("/missing", 2, False)]
    assert [r.discovered_from for r in rows if r.url.endswith("/c")] == ["http://h.test/b"]
    s = c.stats.first()
    assert (s.known, s.visited, s.pending, s.off_host, s.unusable, s.discoveries, s.trapped) == (5, 4, 0, 1, 1, 7, 0)


def test_no_level_is_dropped(spark, monkeypatch):
    """A limit leaves its last level pending; without one a chain is followed to its end, whatever is packed on the way."""
    pages = spark.createDataFrame([(f"http://h.test/p{'x' * i}", f'<a href="/p{"x" * (i + 1)}">n</a>') for i in range(6)], "url string, html string")
    cut = crawl(pages, ["http://h.test/p"], rules=None, depth=3)
    assert [r.url for r in cut.pending.collect()] == ["http://h.test/pxxx"] and cut.stats.first().pending == 1 and cut.frontier.count() == 3
    monkeypatch.setattr(frontier, "PACK", 2)
    whole = crawl(pages, ["http://h.test/p"], rules=None)
    assert [(len(r.url) - 15, r.depth) for r in whole.frontier.orderBy("seq").collect()] == [(i, i) for i in range(7)] and whole.stats.first().pending == 0
    assert signature(crawl).parameters["depth"].default is None


def test_resume_and_no_seed(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    done = spark.createDataFrame([("http://h.test/b",)], "url string")
    assert {r.url for r in crawl(pages, ["http://h.test/"], host="h.test", resume=done).frontier.collect()} == {"http://h.test/", "http://h.test/a", "http://h.test/c"}
    assert crawl(pages, ["nothing"]).frontier.count() == 0


@pytest.fixture
def visits(spark):
    rows = [("a", i, f"s{i % 2}", 0) for i in range(30)] + [("b", i, "s", int(i == 3)) for i in range(30)] + [("c", i, f"s{i}", 0) for i in range(30)]
    return spark.createDataFrame(rows, "template string, seq long, shape string, novelty long")


def test_trap(visits):
    s = trap_states(visits)
    assert {(r.template, r.seq) for r in s.where("saturated").groupBy("template").agg(F.min("seq").alias("seq")).collect()} == {("a", 24)}


def test_trap_caps(spark):
    pages = spark.createDataFrame([("http://h.test/", "".join(f'<a href="/n/{i}">' for i in range(9)))], "url string, html string")
    c = crawl(pages, ["http://h.test/"], rules=TrapRules(most=4))
    assert c.frontier.count() == 5 and c.stats.first().trapped == 5
    assert c.templates.where("saturated").first().template == "/n/{n}"


def stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streams(spark, visits, tmp_path):
    q = trap_stream(stream(spark, visits, str(tmp_path / "v"))).writeStream.format("memory").queryName("traps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.template, r.seq) for r in spark.table("traps").collect()] == [("a", 24)]
    caps = planted.captures(spark.range(1).select(F.col("id").alias("doc_id")), "doc_id").withColumn("mime_type", F.col("content_type"))
    q = token_stream(stream(spark, caps, str(tmp_path / "c"))).writeStream.format("memory").queryName("tokens").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tokens").count() == len(planted.BODIES)
    events = spark.createDataFrame([(1, "2026-01-01 00:10:00", "a", 1.0), (2, "2026-01-01 00:50:00", "a", 2.0), (3, "2026-01-01 01:10:00", "a", 4.0)], "user_id int, t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted((r.n, r.total) for r in event_windows(events).collect()) == [(1, 4.0), (2, 3.0)]


def test_one_worker_for_each_task(spark):
    """Links are found and keyed in one Python step, so a task has one worker; seeds need none. It had up to three."""
    began = spark._jsparkSession.sharedState().statusStore().executionsCount()
    crawl(spark.createDataFrame(PAGES, "url string, html string"), ["http://h.test/"], host="h.test").frontier.count()
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [ran.apply(i).physicalPlanDescription().partition("\n\n(1)")[0] for i in range(int(began), ran.size())]
    assert len(plans) > 5 and not any("ArrowEvalPython" in p for p in plans)
    assert max(len(re.findall(r"MapInArrow", p.partition("Initial Plan")[0])) for p in plans) == 1
