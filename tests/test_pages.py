"""Tag stream, readable extraction, result pages, tool calls and the cache, against plain versions and odd inputs."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from foragelake.functions import html as H
from foragelake.functions.tags import DEEPEST, parse
from foragelake.operators.records import timed_calls
from foragelake.operators.search import keyless_search, result_rows
from foragelake.plans.queries import QUERIES
from foragelake.streaming.ttl import cache_hits, stream_cache_hits
from tests.conftest import SF

ARTICLE = "<html><head><title>Example Title</title></head><body><nav><a href='/a'>Home</a> <a href='/b'>More, and more, and more links</a></nav><article><h1>Example Title</h1><p>First paragraph.</p><p>Second paragraph.</p></article><footer>All rights reserved by the owners of this site.</footer></body></html>"
NESTED = "<style>.btn { color: red; &:hover { color: blue; } }</style>"


def test_readable_articles():
    title, byline, text, mode = H.read_page(ARTICLE)
    assert (title, byline, mode) == ("Example Title", None, "readability")
    assert "First paragraph." in text and "Second paragraph." in text and "rights" not in text and "Home" not in text
    page = "<title>How to bake good bread at home | The Site</title><meta name='author' content='A. Baker'><div class=sidebar><p>Buy, buy, buy more of everything that we sell here.</p></div><div class=post>" + "".join(f"<p>Paragraph {i}, with some words, and some more of them in it.</p>" for i in range(12)) + "<ul><li><a href=x>one link</a><li><a href=y>two link</a></ul></div>"
    title, byline, text, _ = H.read_page(page)
    assert (title, byline) == ("How to bake good bread at home", "A. Baker")
    assert text.startswith("Paragraph 0") and "Paragraph 11" in text and "Buy" not in text and "one link" not in text
    # Nothing but furniture: it is read less strictly, and in the end as the whole body.
    assert "sell" in H.read_page("<body><div class=sidebar><p>Buy more of what we sell here today.</p></div>")[2]
    assert H.read_page("<body>a &amp;amp; b") == (None, None, "a &amp; b", "readability")
    assert H.read_page("") == (None, None, "", "readability")


def test_pages_that_are_read_the_plain_way():
    page = f"<html><head><title>Tom &amp;amp; Jerry</title>{NESTED}</head><body><main><h1>Broken</h1><p>Recoverable text.</p><script>x</script></main></body></html>"
    assert H.read_page(page) == ("Tom &amp; Jerry", None, "Broken Recoverable text.", "fallback")
    for css, mode in (("@media x { .a { b: c } }", "readability"), (".a { b: '}{' } /* { */", "readability"), (".a { } }", "fallback"), (".a { .b { } }", "fallback"), ("@font-face { a { } }", "fallback")):
        assert H.read_page(f"<style>{css}</style>x")[3] == mode, css


@pytest.mark.parametrize("unit", ["<main>", "<script ", "<script>", "</script>", "<p>", "<a ", "<!--", '<a href="', "<", "<title>", "&#", "<td>", "<p><button><span><div>"])
def test_long_broken_pages_take_time_by_their_length(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    H.plain_title(page), H.plain_text(page)
    assert time.process_time() - began < 2
    result_rows(page), H.read_page(page[:300_000])
    assert time.process_time() - began < 30


class Walk(HTMLParser):
    """Text outside of scripts and styles, by the standard library."""

    def __init__(self):
        super().__init__()
        self.out, self.inside = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)


def test_tree_has_the_text_of_every_page(spark):
    for (page,) in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        walk = Walk()
        walk.feed(page)
        walk.close()
        tree = parse(page)
        unread = {k for i, e in enumerate(tree.elements) if e.name in ("script", "style", "title") for k in range(e.first, e.last)}
        assert "".join(p for k, p in enumerate(tree.pieces) if k not in unread) == "".join(walk.out)
        for i, e in enumerate(tree.elements[1:], 1):
            up = tree.elements[e.parent]
            assert e.parent < i < up.end and up.first <= e.first <= e.last <= up.last and e.end <= up.end


def test_tree_shapes():
    tree = parse("<ul><li>a<li>b<ul><li>c</ul></ul><p>d<div>e</div></p>f<table><tr><td>g<td>h<tr><td>i</table></b>")
    assert [tree.text(i) for i in tree.named("li")] == ["a", "bc", "c"]
    assert [tree.text(i) for i in tree.named("p")] == ["d"]
    assert [tree.text(i) for i in tree.named("tr")] == ["gh", "i"] and [tree.text(i) for i in tree.named("td")] == ["g", "h", "i"]
    assert parse("<a title='x>y' CLASS=\"b c\" hidden>t").elements[1].attributes == {"title": "x>y", "class": "b c", "hidden": ""}
    deep = parse("<div>" * 3000 + "x")
    assert max(e.last - e.first for e in deep.elements) == 1 and len(deep.elements) == 3001 and DEEPEST < 3000
    assert parse("a<!-- b --!>c").pieces == ["a"] and parse("a <b").pieces == ["a "] and "".join(parse("1 < 2 <3").pieces) == "1 < 2 <3"


def test_readable_query_reads_every_page(spark):
    from foragelake.plans.inputs import HTML, load

    rows = {r["page_id"]: r for r in QUERIES["html_readable"](spark, SF).collect()}
    pages = {r["page_id"]: (r["html"], r["content_type"]) for r in load(spark, SF, HTML).collect()}
    assert rows.keys() == pages.keys()
    seen = set()
    for i, (page, kind) in pages.items():
        r, text = rows[i], rows[i]["text"]
        assert (r["mode"] == "fallback") == (i % 5 == 0) and len(text) <= 4000
        if i % 5:
            assert text[:4] in page and "track(0)" not in text
        low = (f"<style>.a {{ b: c; &:hover {{ d: e; }} }}</style>{page}" if i % 5 == 0 else page).lower()
        shell = "<script" in low and ('id="app"' in low or 'id="root"' in low)
        size, whole = len(" ".join(text.split())), len(" ".join(low.split()))
        weak = 0 < size < 120 and (size / whole < 0.02 or any(x in low for x in ("enable javascript", "javascript required", "please turn on javascript")))
        assert r["status"] == ("unsupported" if "text/html" not in kind else "needs_headless" if shell or len(text) < 40 or weak else "ok"), i
        assert r["bot_check"] == ("just a moment" in f"{r['title'] or ''}\n{text}".lower() or "checking your browser" in text.lower())
        seen.add((r["status"], r["bot_check"], r["mode"]))
    assert len(seen) >= 5
    assert spark.range(1).select(H.readable(F.lit(None).cast("string"))["text"].alias("t")).first()["t"] is None


def test_result_pages():
    basic = '<div class="result"><a class="result__a" href="https://example.com/article">Example Article</a><a class="result__snippet">First example snippet.</a></div>'
    assert result_rows(basic) == [("Example Article", "https://example.com/article", "First example snippet.")]
    nested = "<div class='results'><article class='x result'><div class=result><a href=' /u ' class='result__a'>T</a></div></article></div>"
    assert result_rows(nested) == [("T", "/u", ""), ("T", "/u", "")]
    assert result_rows('<div class="result"><a class="result__a">no link</a></div><div class="my-result"><a class="result__a" href="x">y</a></div>') == []


def plain_calls(events):
    calls = []
    for session, tool, pos, phase, ms, failed in sorted(events, key=lambda e: (e[2], e[3] == "end", e[4])):
        if phase == "start":
            calls.append([session, tool, pos, ms, None, None, None])
        elif phase == "end":
            open_ = next((c for c in reversed(calls) if c[:2] == [session, tool] and c[4] is None), None)
            if open_:
                open_[4:] = [ms, ms - open_[3], failed]
    return sorted(map(str, calls))


def test_tool_calls_close_the_latest_open_call(spark):
    rng = random.Random(7)
    events = [(rng.randrange(3), rng.choice(["bash", "read", None]), p, rng.choice(["start", "start", "end", "end", "note"]), p * 10 + rng.randrange(5), rng.choice([True, False])) for p in range(400)]
    events += [(9, "bash", 1, "end", 5, False), (9, "bash", 2, "start", 7, None), (9, "bash", 2, "end", 8, True)]
    made = spark.createDataFrame(events, "session_id long, tool_name string, pos long, phase string, ms long, failed boolean")
    assert sorted(str(list(r)) for r in timed_calls(made).collect()) == plain_calls(events)
    assert timed_calls(made.limit(0)).collect() == []


def plain_hits(accesses, ttl):
    out, expires = [], {}
    for key, i, ms in sorted((a for a in accesses if a[0] is not None and a[2] is not None), key=lambda a: (a[2], a[1])):
        hit = expires.get(key, -(10**18)) > ms
        if not hit:
            expires[key] = ms + ttl
        out.append((key, i, hit))
    return sorted(out)


ACCESSES = "key string, event_id long, ms long"


def some_accesses(n=600, span=9000):
    rng = random.Random(4)
    return [(rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.randrange(span)) for i in range(n)]


@pytest.mark.parametrize("slices", [1, 3, 1000])
def test_hot_keys_are_cut_into_slices(spark, slices):
    accesses = [*some_accesses(300, 30_000), (None, 5000, 3), ("a", 5001, None)]
    made = spark.createDataFrame(accesses, ACCESSES).withColumn("more", F.col("event_id") * 2)
    found = cache_hits(made, 70, slice_ttls=slices).collect()
    assert sorted((r["key"], r["event_id"], r["hit"]) for r in found) == plain_hits(accesses, 70)
    assert all(r["more"] == 2 * r["event_id"] for r in found)


def test_stream_judges_late_files_in_event_time_and_forgets(spark, tmp_path):
    accesses = some_accesses()
    rng = random.Random(8)
    by_time = sorted(accesses, key=lambda a: a[2] + rng.randrange(900))
    source, log = tmp_path / "in", tmp_path / "log"
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        chunks = [by_time[i : i + 150] for i in range(0, len(by_time), 150)] + [[(None, None, 10**7)]]
        for chunk in chunks:
            spark.createDataFrame(chunk, ACCESSES).coalesce(1).write.mode("append").parquet(str(source))
            read = spark.readStream.schema(ACCESSES).option("maxFilesPerTrigger", 1).parquet(str(source))
            out = stream_cache_hits(read, 400, delay="1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(log))
            out.trigger(availableNow=True).start().awaitTermination()
        left = {v: spark.read.format("statestore").option("stateVarName", v).load(str(log)).count() for v in ("waiting", "expires", "timer")}
    finally:
        spark.conf.unset(name)
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("key", "event_id", "hit").collect()]
    assert sorted(found) == plain_hits(accesses, 400)
    assert left == {"waiting": 0, "expires": 0, "timer": 0}


def test_requests_that_share_an_id(spark):
    page = '<div class="result"><a class="result__a" href="u">T</a></div>'
    requests = spark.createDataFrame([(1, "q", 1), (1, "q", 2), (1, " q ", 10**9), (2, "r", 1), (2, " ", 1), (3, "q", None)], "request_id long, query string, ms long")
    answers = spark.createDataFrame([("q", page, None), ("r", None, "HTTP 429")], "query string, html string, failure string")
    found = sorted((r["request_id"], r["status"], r["code"] or "", r["cache_hit"], len(r["results"])) for r in keyless_search(requests, answers).collect())
    assert found == [(1, "ok", "", False, 1), (1, "ok", "", False, 1), (1, "ok", "", True, 1), (2, "error", "BLOCKED", False, 0), (2, "error", "INVALID_QUERY", False, 0), (3, "ok", "", False, 1)]


def test_short_ways_say_what_the_long_ones_say(spark):
    """White space of any character, pages whose elements are looked for first, and routes told by host and ending."""
    from foragelake.functions import readers as R
    from foragelake.functions import text as T

    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    texts = [f" a{x}b {x}{x} c{x}" for x in chars]
    old = F.trim(F.regexp_replace("t", f"{T.WS}{{2,}}|{T.ODD_WS}", " "))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.collapse(F.col("t")).alias("new"), old.alias("old")).collect()
    assert all(r["new"] == r["old"] for r in rows)
    assert all(H._squeezed(r["t"]) == H._SPACES.sub(" ", r["t"]).strip(" ") for r in rows)
    pages = ["", "<TITLE>a\x85b</TITLE><BODY id=x>c\x1c\ufeff d<SVG>e</svg> f</Body>g", "<title>x", "<script></script><div ID=\"APP\">y", "<main>a<style>b</style >c</style>d</main>", "z" * 5000, None]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    read = df.select(H.fetched(F.col("html")).alias("r"), H.plain(F.col("html")).alias("p"), H.is_script_shell(F.col("html")).alias("s")).collect()
    for r in read:
        assert r["r"]["title"] == r["p"]["title"] and r["r"]["text"] == (r["p"]["text"] and r["p"]["text"][: H.PAGE_CAP]) and r["r"]["shell"] == r["s"]
    urls = ["https://www.github.com/a/b", "https://github.com/a", "http://x.y/a%2Epdf", "http://x.y/a/../b.PDF?q", "http://x.y/.%2e/c%2epdf", "https://youtu.be/v", "https://www.youtube.com/shorts/v", "https://m.youtube.com/watch?v=1", "nothing", "HTTPS://X.Y", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    u = F.col("u")
    long = F.when(R.repo_shape(u).isNotNull(), "github").when(R.is_pdf(u), "pdf").when(R.video_id(u).isNotNull(), "youtube").when(u.rlike("^https?://"), "http").otherwise("unsupported")
    assert [r for r in df.select(R.route(u).alias("r")).collect()] == [r for r in df.select(long.alias("r")).collect()]


def test_a_reading_goes_straight_into_judgements(spark):
    """A reading comes from Python, and no lambda's body may hold it; the text in a column of its own says the same."""
    from foragelake.functions import text as T

    pages = [ARTICLE, NESTED, "<body>Please enable JavaScript.</body>", "<body>" + "\u00a0 " * 500 + "word " * 90 + "</body>", "<body>short</body>" + " " * 9 + "<b>" * 4000, "", None]
    df = spark.createDataFrame([(p,) for p in pages], "html string").withColumn("kind", F.lit("text/html"))
    html = F.col("html")

    def judged(rows, text, page=html):
        return rows.select(T.summary(text).alias("s"), H.is_weak(page, text).alias("w"), H.fetch_status(F.col("kind"), page, text).alias("f"), T.is_bot_check(F.lit("t"), text).alias("b"), T.excerpt(text).alias("e"), T.word_count(text).alias("n"))

    held = df.withColumn("text", H.text(html)).localCheckpoint()
    found = judged(df, H.text(html))
    assert found.collect() == judged(held, F.col("text")).collect()
    assert found._jdf.queryExecution().executedPlan().toString().count("BatchEvalPython") == 1
    same = F.udf(lambda p: p, "string", useArrow=False)
    assert judged(held, F.col("text"), same(html)).collect() == judged(held, F.col("text")).collect()
