"""One query for each operator or group of operators, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foragelake.functions import html as H
from foragelake.functions import readers as R
from foragelake.functions import text as T
from foragelake.functions import urls as U
from foragelake.functions import views as V
from foragelake.operators import config as B
from foragelake.operators import evaluation as A
from foragelake.operators import evidence as E
from foragelake.operators import records as C
from foragelake.operators import requests as Q
from foragelake.operators import search as S
from foragelake.operators.health import health_lines
from foragelake.plans import inputs as I
from foragelake.plans.explore import explore, research, steps_of
from foragelake.sources.configs import commit_writes, file_status, read_store, unchanged_runs
from foragelake.sources.recorded import record, recorded
from foragelake.sources.shared import dealt, shared_dir, written
from foragelake.streaming.ttl import cache_hits, stream_cache_hits

TTL_MS = 6 * 3600 * 1000


def _urls(spark: SparkSession, d: str) -> DataFrame:
    return I.load(spark, d, I.URLS)


def _serp(spark: SparkSession, d: str) -> DataFrame:
    return I.load(spark, d, I.SERP, urls=_urls(spark, d))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return I.load(spark, d, I.QUESTIONS)


def page_profile(spark, d):
    """Every crawled page in one pass over the table: canonical URL, host, kind, title, status, bot flag, summary."""
    p = I.load(spark, d, I.HTML).withColumn("text", H.text(F.col("html"))).withColumn("title", H.title(F.col("html")))
    c = F.col
    return p.select("page_id", U.canonical(c("url")).alias("canonical"), U.host(c("url")).alias("host"), U.profile(c("url"))["kind"].alias("kind"), "title", H.fetch_status(c("content_type"), c("html"), c("text")).alias("status"), T.is_bot_check(c("title"), c("text")).alias("bot_check"), T.summary(c("text")).alias("summary"))


def url_canonical(spark, d):
    return _urls(spark, d).select("page_id", U.canonical(F.col("url")).alias("canonical"), U.canonical(F.col("url"), drop_www=False).alias("with_www"), U.host_or_url(F.col("url")).alias("host_key"))


def url_dedupe(spark, d):
    return _urls(spark, d).withColumn("canonical", U.canonical(F.col("url"))).groupBy("canonical").agg(F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("url"), F.count(F.lit(1)).alias("n"))


def host_counts(spark, d):
    return _urls(spark, d).groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def direct_urls(spark, d):
    return _questions(spark, d).select("query_id", F.array_join(U.direct_urls(F.col("query")), " ").alias("urls"))


def source_profile(spark, d):
    p = U.profile(F.col("url"))
    return _urls(spark, d).select("page_id", p["kind"].alias("kind"), p["source_kind"].alias("source_kind"), p["prefers_rendering"].alias("prefers_rendering"), U.source_rank(p["source_kind"]).alias("rank"))


def html_title(spark, d):
    return I.load(spark, d, I.HTML).select("page_id", H.title(F.col("html")).alias("title"))


# Every fifth page gets a style sheet that strict parsers reject, so that it is read the plain way.
_STYLED = f"SELECT page_id, content_type, CASE WHEN page_id % 5 = 0 THEN concat('<style>.a {{{{ b: c; &:hover {{{{ d: e; }}}} }}}}</style>', html) ELSE html END AS html FROM ({I.HTML}) h"


def html_readable(spark, d):
    """Every page by its article: title, byline, text, how it was read, and what the gates say about that text."""
    c = F.col
    p = I.load(spark, d, _STYLED).select("page_id", "content_type", "html", H.readable(c("html")).alias("r"))
    return p.select("page_id", "r.*", H.fetch_status(c("content_type"), c("html"), c("r.text")).alias("status"), T.is_bot_check(c("r.title"), c("r.text")).alias("bot_check"))


def html_fallback_text(spark, d):
    return I.load(spark, d, I.HTML).select("page_id", H.text(F.col("html")).alias("text"))


_ENCODED = "SELECT page_id, concat('a &amp;lt; b &#', 65 + page_id % 26, '; &#x', CASE page_id % 2 WHEN 0 THEN '41' ELSE '20ac' END, '; &NBSP;&quot;&copy; ', page_id) AS t FROM {pages}"


def entity_decode(spark, d):
    return I.load(spark, d, _ENCODED).select("page_id", H.decode_entities(F.col("t")).alias("decoded"))


_RENDERED = "SELECT page_id, concat('Show more  show more Show More ', page_id, ' Privacy Terms Privacy Terms', chr(9), ' end ') AS t FROM {pages}"


def rendered_cleanup(spark, d):
    return I.load(spark, d, _RENDERED).select("page_id", H.clean_rendered(F.col("t")).alias("cleaned"))


def word_excerpt(spark, d):
    t = F.col("text")
    # Collapsed once, for the count and for the support.
    texts = I.load(spark, d, "SELECT doc_id, text FROM {documents}").select("doc_id", "text", T.collapse(t).alias("bare"))
    return texts.select("doc_id", T.words_of(F.col("bare")).alias("words"), T.excerpt(t).alias("short"), T.excerpt(t, 500).alias("long"), T.cut(F.col("bare"), 120).alias("support"))


def fetch_status(spark, d):
    p = I.load(spark, d, I.HTML).withColumn("text", H.text(F.col("html")))
    c = F.col
    return p.select("page_id", H.is_script_shell(c("html")).alias("shell"), H.is_weak(c("html"), c("text")).alias("weak"), T.is_bot_check(H.title(c("html")), c("text")).alias("bot_check"), H.fetch_status(c("content_type"), c("html"), c("text")).alias("status"))


def query_plan(spark, d):
    return steps_of(_questions(spark, d))


def important_words(spark, d):
    return _questions(spark, d).select("query_id", T.important_words(F.col("query")).alias("words"), T.wants_discussion(F.col("query")).alias("discussion"), (T.trim(F.col("query")) == "").alias("invalid"))


_PAYLOADS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'brave' WHEN 1 THEN 'exa' WHEN 2 THEN 'tavily' WHEN 3 THEN 'youcom' ELSE 'searxng' END AS provider,
 CASE page_id % 5
  WHEN 0 THEN concat('{{"web":{{"results":[{{"title":"T', page_id, '","url":"http://a/', page_id, '","description":"d"}},{{"title":5,"url":"http://b"}}]}}}}')
  WHEN 1 THEN concat('{{"results":[{{"title":"T","url":"http://a/', page_id, '","text":7}},{{"url":"http://b"}}]}}')
  WHEN 2 THEN '{{"results":[{{"title":"T","url":"http://a","content":"c"}}]}}'
  WHEN 3 THEN '{{"results":[]}}' ELSE 'no json' END AS body FROM {pages}"""


def serp_parse_json(spark, d):
    return S.parse_payloads(I.load(spark, d, _PAYLOADS)).withColumn("rank", F.col("rank").cast("int"))


# Result pages whose titles are the beginnings of documents: any element, either quote, several classes, nested, commented.
_PAGES = """SELECT doc_id, CASE doc_id % 8
  WHEN 0 THEN concat('<div class="result web"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2F', doc_id, '&rut=1"> A <b>', t, '</b> </a><a class="result__snippet">s ', t, '</a></div><div class="result"><a class="result__a" href="">none</a></div>')
  WHEN 1 THEN concat('<article class=', q, 'x result', q, '><h2 class=big><a href=', q, 'https://b.org/', doc_id, q, ' class=', q, 'y result__a', q, '>', t, '</a></h2><p class=', q, 'result__snippet', q, '>', t, ' end</p></article>')
  WHEN 2 THEN concat('<SECTION data-k="1" CLASS="result"><span class="result__snippet"></span><a data-x="1" class="result__a" href=https://c.org/', doc_id, '>', t, '</a></SECTION>')
  WHEN 3 THEN concat('<div class="results"><a class="result__a" href="u">', t, '</a></div>')
  WHEN 4 THEN concat('<p>No results found.</p>', t)
  WHEN 5 THEN concat('<p>Unusual traffic</p>', t)
  WHEN 6 THEN concat('<ul><li class="result"><!-- <a class="result__a" href="z">no</a> --><a class="result__a" href="https://d.org/?a=1&amp;b=', doc_id, '">', t, '</a><li class="result"><a href="/next" class="result__a">', t, ' 2</a><a class="result__snippet">', t, '</a></ul>')
  ELSE concat('<p>hello ', t, '</p>') END AS html
FROM (SELECT doc_id, chr(39) AS q, translate(substr(coalesce(text, ''), 1, 80), concat('<>&"', chr(39)), '') AS t FROM {documents}) d"""


def serp_outcome(spark, d):
    p = I.load(spark, d, _PAGES).withColumn("hits", S.parse_result_page(F.col("html")))
    first, last = F.get("hits", F.lit(0)), F.try_element_at("hits", F.lit(-1))
    return p.select("doc_id", F.size("hits").alias("n"), first["title"].alias("title"), first["url"].alias("url"), first["snippet"].alias("snippet"), last["url"].alias("last_url"), S.page_outcome(F.col("html"), F.size("hits")).alias("outcome"))


_REDIRECTS = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2F', page_id) WHEN 1 THEN 'https://duckduckgo.com/l/?x=1' ELSE url END AS raw FROM {pages}"


def redirect_unwrap(spark, d):
    raw = I.load(spark, d, _REDIRECTS)
    return raw.select("page_id", U.unwrap_redirect(F.col("raw")).alias("url"), U.search_url(F.concat(F.lit("a b&"), F.col("page_id").cast("string"))).alias("search_url"))


def fanout_merge(spark, d):
    return S.merge_providers(S.in_time(_serp(spark, d)), "query_id", "step").drop("step")


def fanout_auto(spark, d):
    return S.auto_merge(_serp(spark, d), "query_id", "step").drop("step").withColumn("pos", F.col("pos").cast("int"))


def fanout_providers(spark, d):
    return S.providers_used(_serp(spark, d), "query_id", "step").drop("step")


def fanout_weak(spark, d):
    return S.weak_primary(_serp(spark, d), "query_id", "step").drop("step")


_PRIMARY = "SELECT page_id, 'searxng' AS backend, CASE page_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'needs_headless' ELSE 'ok' END AS status, CASE page_id % 3 WHEN 0 THEN 'down' END AS message FROM {pages}"
_FALLBACK = "SELECT page_id, 'duckduckgo' AS backend, CASE page_id % 2 WHEN 0 THEN 'ok' ELSE 'error' END AS status, CASE page_id % 2 WHEN 1 THEN 'also down' END AS message FROM {pages} WHERE page_id % 5 <> 0"


def search_fallback(spark, d):
    return S.with_fallback(I.load(spark, d, _PRIMARY), I.load(spark, d, _FALLBACK), "page_id")


def fetch_fallback(spark, d):
    return S.with_fallback(I.load(spark, d, _PRIMARY), I.load(spark, d, _FALLBACK), "page_id", also=("needs_headless",))


def candidate_topk(spark, d):
    hits = _serp(spark, d).filter("provider_pos = 0").withColumn("pos", F.col("rank")).withColumn("query", F.when(F.col("query_id") % 2 == 0, "reddit views").otherwise("how"))
    return S.top_candidates(hits, "query_id").select("query_id", "candidate", "url", "title", "score")


def _evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    u = _urls(spark, d)
    said = F.when(F.col("page_id") % 7 == 0, "this is deprecated, not recommended").when(F.col("page_id") % 5 == 0, "the recommended way").otherwise("plain")
    return u.select(F.floor((F.col("page_id") % I.EXTRA) / 30).alias("query_id"), F.col("page_id").alias("ordinal"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), "url", U.profile(F.col("url"))["source_kind"].alias("source_kind"), F.lit("http").alias("method"), said.alias("summary"), said.alias("support"))


def evidence_rank(spark, d):
    return E.rank_evidence(_evidence_rows(spark, d), "query_id").select("query_id", "pos", "title", "url", "source_kind")


def evidence_quality(spark, d):
    ranked = E.rank_evidence(_evidence_rows(spark, d), "query_id")
    groups = ranked.select("query_id").distinct()
    gaps = groups.filter("query_id % 4 = 0").select("query_id", E.unreadable_message(F.when(F.col("query_id") % 8 == 0, "https://stackoverflow.com/questions/1").otherwise("https://a.b/")).alias("message"))
    low = groups.filter("query_id % 5 = 0").select("query_id", F.lit("bot-check").alias("kind"))
    q = E.quality(ranked, gaps, low, groups, "query_id")
    step = E.next_step(F.lit(0), F.when(F.col("query_id") % 3 == 0, F.lit("https://x/")), F.lit(0))
    return q.select("query_id", "total", "official", "community", "thread", "distinct_hosts", "strong", "only_community", "low_diversity", "conflict", F.array_join("reasons", ",").alias("reasons"), step.alias("next_step"), E.caveat_text(F.lit(True), F.col("reasons")).alias("caveat"))


def _research_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """questions, steps, searches, hits, fetches and rendered pages of the research run."""
    c = F.col
    q = _questions(spark, d).filter(T.trim(c("query")) != "")
    steps = written(steps_of(q), "plan")
    n = F.lit(7)
    # A step finds the pages of one slot, 12 crawled and up to 12 added ones, however many pages there are. A page is scored
    # once, before the many steps that find it.
    pages = _urls(spark, d).withColumn("slot", F.floor((c("page_id") % I.EXTRA) / 12))
    slots = pages.agg(F.max("slot")).first()[0] + 1
    found = ((c("query_id") * 13 + c("step") * n) % slots).alias("found")
    searches = steps.select("query_id", "step", F.when((c("query_id") + c("step")) % 11 == 0, "error").otherwise("ok").alias("status"), F.when((c("query_id") + c("step")) % 22 == 0, "search down").alias("message"), found)
    hits = S.url_scores(pages).select(c("slot").alias("found"), c("page_id").alias("pos"), F.concat(F.lit("hit "), c("page_id").cast("string")).alias("title"), "url", F.lit("s").alias("snippet"), "plain", "talk")
    # One page stands for each URL, and its HTML is read once.
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    # The narrow side is hashed, so that pages needn't be sorted.
    html = I.load(spark, d, I.HTML).select("page_id", "html").join(first.hint("shuffle_hash"), "page_id").select("url", "html", H.fetched(c("html")).alias("r"))
    html = html.select("url", "html", "r.*")
    method = T.let(R.route(c("url")), lambda m: F.when(m.isin("github", "pdf", "youtube"), m).otherwise("http"))
    fetches = html.select("url", c("url").alias("final_url"), H.fetch_status(F.lit("text/html"), c("html"), c("text"), c("shell")).alias("status"), method.alias("method"), "title", "text", F.lit(None).cast("string").alias("message"))
    fetches = written(fetches, "fetches")
    rendered = fetches.filter("status = 'needs_headless'").select("url", F.when(F.length("url") % 2 == 0, "ok").otherwise("blocked").alias("status"), F.lit("Rendered").alias("title"), F.lit("rendered text that is recommended").alias("text"))
    return {"questions": q, "steps": steps, "searches": searches, "hits": hits, "fetches": fetches, "rendered": rendered}


def research_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """questions, searches, hits (for each search), fetches and rendered pages of the research run."""
    t = _research_tables(spark, d)
    hits = t["searches"].select("query_id", "step", "found").join(t["hits"], "found").drop("found")
    return t["questions"], t["searches"].drop("found"), hits, t["fetches"], t["rendered"]


def _research(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return explore(**_research_tables(spark, d))


def explore_answers(spark, d):
    # How many findings and sources there are, not their words.
    a, n = research(**_research_tables(spark, d))[0], F.col("n_ranked")
    return a.select("query_id", "action", F.least(n, F.lit(5)).cast("int").alias("n_findings"), F.least(n, F.lit(4)).cast("int").alias("n_sources"), "caveat", "search_passes", "fetched_pages", "headless_attempts", "exhausted_budget", F.array_join("reasons", ",").alias("reasons"))


def explore_evidence(spark, d):
    # Which evidence, not its words.
    return research(**_research_tables(spark, d))[1].select("query_id", "pos", "url", "source_kind", "method")


def explore_views(spark, d):
    a, _ = _research(spark, d)
    c = F.col
    internal = V.internal_summary(c("search_passes"), c("fetched_pages"), c("headless_attempts"), F.lit(""))
    preview, verbose = V.explore_preview(c("findings"), c("sources"), internal), V.explore_verbose(c("findings"), c("sources"), internal, c("caveat"))
    mode = F.when(c("query_id") % 3 == 0, "preview").when(c("query_id") % 3 == 1, "verbose").otherwise("compact")
    return a.select("query_id", V.select_view(mode, V.explore_compact(c("findings"), c("sources")), preview, verbose).alias("shown"), V.model_text(c("findings"), c("sources"), c("caveat")).alias("model_text"))


def search_views(spark, d):
    merged = S.merge_providers(S.in_time(_serp(spark, d)), "query_id", "step")
    hits = merged.groupBy("query_id", "step").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "url", "snippet"))).alias("hits"))
    all_ = S.providers_used(_serp(spark, d), "query_id", "step").join(hits, ["query_id", "step"], "left")
    c, n = F.col, F.coalesce(F.size("hits"), F.lit(0))
    n = F.when(c("hits").isNull(), 0).otherwise(n)
    note = V.fanout_note(c("providers"), c("skipped"))
    prefix = V.fallback_prefix(F.when(c("query_id") % 5 == 0, "searxng"), F.lit("duckduckgo"))
    return all_.select("query_id", V.search_compact(F.when(n == 0, "error").otherwise("ok"), n, F.lit(None).cast("string"), prefix, note).alias("compact"), V.search_preview(c("hits")).alias("preview"), V.search_verbose(c("hits")).alias("verbose"))


def fetch_views(spark, d):
    c = F.col
    p = I.load(spark, d, I.HTML).withColumn("text", H.text(c("html"))).withColumn("title", H.title(c("html"))).withColumn("status", H.fetch_status(c("content_type"), c("html"), c("text")))
    return p.select("page_id", V.fetch_compact(c("status"), c("text"), F.lit(None).cast("string"), F.lit("")).alias("compact"), V.fetch_preview(c("title"), c("text")).alias("preview"), V.fetch_verbose(c("status"), c("url"), c("title"), c("text")).alias("verbose"))


def reader_route(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("page_id", R.route(u).alias("route"), R.repo_shape(u).alias("shape"), R.raw_url(u).alias("raw_url"), R.video_id(u).alias("video_id"), F.when(R.is_pdf(u), R.pdf_title(u, F.lit(" "))).alias("pdf_title"))


def thread_text(spark, d):
    """Conversations as threads: the first turn is the body, the others are comments."""
    c = I.load(spark, d, "SELECT conv_id, turn, text FROM {conversations}")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = F.transform("t", lambda x: F.when(x["turn"] % 3 == 1, F.lit("")).otherwise(x["text"]))
    text = R.thread_text(F.get(said, F.lit(0)), F.slice(said, 2, 1 << 20))
    return g.select("conv_id", R.capped(text).alias("text"), R.is_truncated(text).alias("truncated"), R.transcript(said).alias("transcript"))


def repo_listing(spark, d):
    n = I.load(spark, d, "SELECT CAST(floor(page_id / 20) AS BIGINT) AS repo, page_id, url FROM {pages}")
    g = n.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("page_id", F.when(F.col("page_id") % 3 == 0, "dir").otherwise("file").alias("type"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("name")))).alias("entries"))
    return g.select("repo", R.listing(F.lit("readme"), F.col("entries")).alias("text"))


def tool_call_verdict(spark, d):
    m = C.tool_metrics(I.load(spark, d, I.LOG)).withColumn("final_answer", F.when(F.col("session_id") % 9 == 0, " ").otherwise("done"))
    return C.verdict(m).drop("final_answer")


def config_merge(spark, d):
    """Both files of each configuration over the defaults: what holds, what is wrong, and which providers are asked."""
    c = I.load(spark, d, I.CONFIGS).withColumn("m", B.merge_backends(B.parse_backends(F.col("own")), B.parse_backends(F.col("project"))))
    s, f = F.col("m.search"), F.col("m.fetch")
    keys = {"brave": F.col("brave_key"), "exa": F.col("exa_key"), "youcom": F.lit(" "), "tavily": F.lit(None).cast("string")}
    usable = B.usable_providers(s["base_url"], keys)

    def joined(x: Column) -> Column:
        return F.array_join(x, ",")

    return c.select(
        "config_id", s["provider"].alias("provider"), s["base_url"].alias("base_url"), s["fallback"].alias("fallback"), joined(s["options"]["categories"]).alias("categories"),
        s["options"]["language"].alias("language"), s["options"]["safesearch"].alias("safesearch"), s["fanout"]["mode"].alias("fanout_mode"), joined(s["fanout"]["providers"]).alias("fanout_providers"),
        f["provider"].alias("fetch_provider"), f["base_url"].alias("fetch_base_url"), f["api_key"].alias("api_key"), f["fallback"].alias("fetch_fallback"), joined(f["options"]["formats"]).alias("formats"), f["options"]["only_main"].alias("only_main"),
        F.array_join(B.backend_issues(F.col("m")), "; ").alias("issues"), joined(usable).alias("usable"), joined(B.provider_order(s["provider"], usable, s["fallback"])).alias("provider_order"),
        B.invalid_backend(F.col("m"), "search")["code"].alias("search_code"), B.invalid_backend(F.col("m"), "fetch")["message"].alias("fetch_message"),
    )


def presentation_modes(spark, d):
    own, project = B.parse_presentation(F.col("own")), B.parse_presentation(F.col("project"))
    c = I.load(spark, d, I.CONFIGS).select("config_id", own.alias("o"), project.alias("p"))
    return c.select("config_id", *[B.resolve_mode(F.lit(t), F.col("o"), F.col("p")).alias(t) for t in C.WEB_TOOLS])


def scrape_outcome(spark, d):
    p = I.load(spark, d, I.SCRAPED).withColumn("r", B.scrape_outcome(F.col("url"), F.col("http_status"), F.col("body")))
    return p.select("page_id", "r.*")


def reader_resolve(spark, d):
    """Every page's reader, once its plain read has told status and type."""
    p = I.load(spark, d, I.HTML)
    status = H.fetch_status(F.col("content_type"), F.col("html"), H.text(F.col("html")))
    return p.select("page_id", R.resolve(F.col("url"), status, F.col("content_type")).alias("reader"))


def fanout_passes(spark, d):
    """Providers over all passes of a question; its pages are searched in four passes."""
    serp = _serp(spark, d).withColumn("step", (F.col("rank") % 8 / 2).cast("int")).withColumn("status", F.when((F.col("rank") + F.col("provider_pos")) % 3 == 0, "error").otherwise(F.col("status")))
    return S.providers_over_passes(S.providers_used(serp, "query_id", "step"), "query_id", "step")


_REQUESTS = "SELECT event_id AS request_id, CASE WHEN event_id % 17 = 0 THEN '  ' ELSE concat(' question ', user_id, chr(10)) END AS query, ts FROM {events}"
_ANSWERS = """SELECT DISTINCT concat('question ', user_id) AS query, CASE WHEN user_id % 6 < 3
  THEN concat('<div class="result"><a class="result__a" href="https://a.com/', user_id, '">T ', user_id, '</a><a class="result__snippet">s</a></div>') WHEN user_id % 6 = 3 THEN 'No results found.' WHEN user_id % 6 = 4 THEN 'Captcha' WHEN user_id % 12 = 5 THEN '<p>' END AS html,
  CASE WHEN user_id % 12 = 11 THEN concat(user_id, CASE WHEN user_id % 24 = 11 THEN ' HTTP 429' ELSE ' hang up' END) END AS failure FROM {events} WHERE user_id % 13 <> 4"""


def search_tool(spark, d):
    """The whole search: every event asks its user's question again, which a cache may answer."""
    r = I.load(spark, d, _REQUESTS).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    out = S.keyless_search(r, I.load(spark, d, _ANSWERS), TTL_MS)
    return out.withColumn("title", F.get("results", F.lit(0))["title"]).drop("results")


def settings_url(spark, d):
    raw = F.concat(F.lit(" "), F.col("url"), F.when(F.col("page_id") % 3 == 0, F.lit("#part/")).otherwise(F.lit("")))
    return _urls(spark, d).select("page_id", U.settings_url(raw).alias("r")).select("page_id", "r.*")


_READS = "SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS http_status, CASE WHEN page_id % 8 = 1 THEN 'socket hang up' END AS failure FROM {urls}"


def repo_read(spark, d):
    rows = I.load(spark, d, _READS, urls=_urls(spark, d))
    target = F.coalesce(R.raw_url(F.col("url")), F.lit("https://api.github.com/x"))
    body = F.repeat(F.lit("word "), (F.col("page_id") % 6000).cast("int"))
    out = R.repo_outcome(F.col("url"), target, F.col("http_status"), F.concat(F.lit("T"), F.col("page_id").cast("string")), body, F.col("failure"))
    return rows.select("page_id", out.alias("r")).select("page_id", "r.*")


def config_override(spark, d):
    """What each project's file really sets apart from the user's, and summaries of the whole."""
    c = I.load(spark, d, I.CONFIGS).select("config_id", B.parse_backends(F.col("own")).alias("o"), B.parse_backends(F.col("project")).alias("p"), B.parse_presentation(F.col("own")).alias("po"), B.parse_presentation(F.col("project")).alias("pp"))
    c = c.select("config_id", "po", "pp", B.merge_backends(F.col("o"), F.col("p")).alias("m"), B.merge_backends(F.col("o")).alias("i"))
    modes = B.presentation_override(C.WEB_TOOLS, F.col("pp"), F.col("po"))
    return c.select(
        "config_id", F.to_json(B.backend_override(F.col("m"), F.col("i"))).alias("backends"), modes["default_mode"].alias("default_mode"),
        F.array_join(F.transform(F.array_sort(F.map_entries(modes["tools"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("tools"),
    )


def config_summary(spark, d):
    c = I.load(spark, d, I.CONFIGS).withColumn("m", B.merge_backends(B.parse_backends(F.col("own")), B.parse_backends(F.col("project"))))
    keys = {"brave": F.col("brave_key"), "exa": F.col("exa_key"), "youcom": F.lit(" "), "tavily": F.lit(None).cast("string")}
    usable = B.usable_providers(F.col("m.search.base_url"), keys)
    shown = B.presentation_summary(C.WEB_TOOLS, B.parse_presentation(F.col("own")), B.parse_presentation(F.col("project")))
    return c.select("config_id", B.backend_summary(F.col("m"), usable).alias("backends"), shown.alias("presentation"))


# A search request for each question, and what each service has answered: its own shape, one row without a title, errors.
_ASKED = f"""SELECT query_id AS request_id, query, CASE query_id % 5 WHEN 0 THEN 'searxng' WHEN 1 THEN 'brave' WHEN 2 THEN 'exa' WHEN 3 THEN 'tavily' ELSE 'youcom' END AS provider,
  CASE query_id % 3 WHEN 0 THEN 'http://s.example/base' WHEN 1 THEN 'https://S.example:8080/' END AS base_url, query_id % 4 <> 1 AS has_key, CASE WHEN query_id % 2 = 0 THEN 'news,it' END AS categories,
  CASE WHEN query_id % 3 = 0 THEN 'en' END AS language, CASE WHEN query_id % 4 < 3 THEN CAST(query_id % 4 AS INT) END AS level FROM ({I.QUESTIONS}) q"""
_ANSWERED = f"""SELECT request_id, provider, CAST(CASE WHEN request_id % 11 = 3 THEN 503 ELSE 200 END AS INT) AS http_status, CASE WHEN request_id % 13 = 5 THEN 'no json' WHEN request_id % 13 = 6 THEN '{{{{"results":[]}}}}'
  ELSE concat(CASE provider WHEN 'brave' THEN '{{{{"web":{{{{"results":[' ELSE '{{{{"results":[' END, '{{{{"title":null,"url":"http://n"}}}},{{{{"title":"', t, '","url":"http://a/', request_id, '","',
    CASE provider WHEN 'brave' THEN 'description' WHEN 'exa' THEN 'text' WHEN 'youcom' THEN 'snippet' ELSE 'content' END, '":"about ', t, '"}}}}]', CASE provider WHEN 'brave' THEN '}}}}}}}}' ELSE '}}}}' END) END AS body,
  CASE WHEN request_id % 17 = 2 THEN 'timed out' END AS failure FROM (SELECT request_id, provider, translate(substr(coalesce(query, ''), 1, 60), concat('"', chr(92), chr(9), chr(10), chr(13)), '     ') AS t FROM ({_ASKED}) a WHERE request_id % 19 <> 7) r"""


def provider_search(spark, d):
    """Every question as a request to one of five services, with answers that were recorded in the shared folder."""
    options = F.struct(F.split("categories", ",").alias("categories"), F.col("language"), F.col("level").alias("safesearch"))
    asked = I.load(spark, d, _ASKED).select("request_id", "provider", Q.search_request(F.col("provider"), F.col("query"), F.col("base_url"), options, F.col("has_key")).alias("request"))
    folder = f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}"
    record(I.load(spark, d, _ANSWERED), folder)
    told = Q.search_answers(asked, recorded(spark, folder)).join(asked, ["request_id", "provider"])
    first, r = F.get("results", F.lit(0)), F.col("request")
    return told.select("request_id", "provider", r["method"].alias("method"), r["url"].alias("request_url"), r["body"].alias("request_body"), r["key_header"].alias("key_header"), "status", F.size("results").alias("n"), first["title"].alias("title"), first["url"].alias("url"), first["snippet"].alias("snippet"), "code", "message")


def backend_sets(spark, d):
    """How each merged configuration searches: alone, with a fallback, or as a fanout that takes the fallback in."""
    c = I.load(spark, d, I.CONFIGS).withColumn("m", B.merge_backends(B.parse_backends(F.col("own")), B.parse_backends(F.col("project"))))
    keys = {"brave": F.col("brave_key"), "exa": F.col("exa_key"), "youcom": F.lit(" "), "tavily": F.lit(None).cast("string")}
    found = B.backend_set(F.col("m"), B.usable_providers(F.col("m.search.base_url"), keys))
    return c.select("config_id", found["mode"].alias("mode"), F.array_join(found["providers"], ",").alias("providers"), found["fallback"].alias("fallback"))


# What each configuration's search and fetch services answered to a probe, and how long that took.
_PROBES = """SELECT c_custkey AS config_id, CAST(c_custkey % 13 * 300 AS BIGINT) AS ms, CAST(CASE WHEN c_custkey % 7 = 0 THEN 500 ELSE 200 END AS INT) AS http_status,
  CASE c_custkey % 6 WHEN 0 THEN '{{"web":{{"results":[]}},"results":[]}}' WHEN 1 THEN '{{}}' WHEN 2 THEN 'oops' ELSE '{{"web":{{"results":[1]}},"results":[{{}}]}}' END AS body, CASE WHEN c_custkey % 11 = 3 THEN 'fetch failed' END AS failure FROM {customer}"""


def health_report(spark, d):
    """The lines on every merged configuration's services, from probes that were recorded."""
    c = I.load(spark, d, I.CONFIGS).withColumn("m", B.merge_backends(B.parse_backends(F.col("own")), B.parse_backends(F.col("project")))).join(I.load(spark, d, _PROBES), "config_id")
    keys = {"brave": F.col("brave_key"), "exa": F.col("exa_key"), "youcom": F.lit(" "), "tavily": F.lit(None).cast("string")}
    probe = F.struct("ms", "http_status", "body", "failure")
    return c.select("config_id", F.array_join(health_lines(F.col("m"), keys, probe, probe), "\n").alias("report"))


def config_runs(spark, d):
    """Uses of merged configurations in the order of customers: while one stays the same, it is one run."""
    c = I.load(spark, d, I.CONFIGS).select(F.floor(F.col("config_id") / 50).cast("long").alias("session_id"), F.floor(F.col("config_id") / 3).cast("long").alias("pos"), F.col("config_id"), "own", "project")
    # Three customers in a row use the files of the first.
    files = c.groupBy("session_id", "pos").agg(F.min_by(F.struct("own", "project"), "config_id").alias("f"))
    used = c.select("session_id", "pos", "config_id").join(files, ["session_id", "pos"])
    merged = used.select("session_id", F.col("config_id").alias("pos"), B.merge_backends(B.parse_backends(F.col("f.own")), B.parse_backends(F.col("f.project"))).alias("config"))
    return unchanged_runs(merged)


_BODIES = """SELECT c_custkey AS config_id, CASE c_custkey % 9 WHEN 1 THEN 'no json' WHEN 2 THEN 'null' WHEN 3 THEN concat('{{"defaultMode":"verbose","tools":{{"web_search":{{"mode":"preview"}}}},"name":"', c_name, '"}}')
  WHEN 4 THEN '{{"presentation":null,"defaultMode":"verbose"}}' WHEN 5 THEN '[1]' WHEN 6 THEN concat('{{"presentation":{{"defaultMode":"compact","note":"', c_name, '"}},"backends":{{}}}}') WHEN 7 THEN '' WHEN 8 THEN '{{"backends":{{"search":{{"provider":"exa"}}}}}}' END AS body FROM {customer}"""


def config_status(spark, d):
    """Each configuration file: missing, malformed, with its settings at the root, or with a root of their own; and its mode."""
    p = B.parse_presentation(F.col("body"))
    return I.load(spark, d, _BODIES).select("config_id", file_status(F.col("body")).alias("status"), p["default_mode"].alias("default_mode"), p["tools"]["web_search"].alias("search_mode"))


# Two batches of writes to 26 files a nation, and what one reads back.
_WRITES = """SELECT concat(CASE WHEN c_custkey % 7 = 6 THEN 's' ELSE 'n' END, c_nationkey) AS key, c_custkey + CASE WHEN c_custkey % 2 = 1 THEN 1000000000 ELSE 0 END AS version, CAST(c_custkey % 2 AS INT) AS batch,
  CASE c_custkey % 7 WHEN 0 THEN 'reset' WHEN 4 THEN 'backends' WHEN 5 THEN 'backends' WHEN 6 THEN 'seen' ELSE 'presentation' END AS kind,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 4 THEN concat('{{"search":{{"provider":"exa","note":"', c_name, '"}}}}') WHEN 5 THEN concat('{{"fetch":{{"provider":"firecrawl","apiKey":"secret","baseUrl":"http://f', c_custkey, '"}}}}')
    WHEN 6 THEN concat('{{"lastChangelogVersion":"1.', c_custkey, '.0"}}') ELSE concat('{{"defaultMode":"', CASE c_custkey % 3 WHEN 0 THEN 'compact' WHEN 1 THEN 'preview' ELSE 'verbose' END, '"}}') END AS body FROM {customer}"""


def config_store(spark, d):
    """Keyed writes in two batches, one of which comes twice; the files that stay, read back."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    writes = I.load(spark, d, _WRITES)
    commit = commit_writes(folder)
    for batch in (0, 1, 1):
        commit(writes.filter(F.col("batch") == batch).drop("batch"), batch)
    files, b = read_store(spark, folder), B.parse_backends(F.col("body"))
    return files.select("key", "version", B.parse_presentation(F.col("body"))["default_mode"].alias("default_mode"), b["search"]["provider"].alias("provider"), b["fetch"]["base_url"].alias("base_url"), b["fetch"]["api_key"].alias("api_key"), F.get_json_object("body", "$.lastChangelogVersion").alias("seen"))


_RELEASES = """SELECT doc_id, concat('# Log', chr(10), chr(10), CASE WHEN doc_id % 7 <> 3 THEN concat('## Unreleased', chr(10)) ELSE '' END, CASE doc_id % 5 WHEN 0 THEN concat('### Breaking', chr(10), '- None.', chr(10)) WHEN 1 THEN concat('### Breaking', chr(13), chr(10), ' -  b ', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 2 = 0 THEN '### Added' ELSE '### Fixed' END, chr(10), CASE WHEN doc_id % 3 = 0 THEN '- ' ELSE 'so ' END, coalesce(text, ''), chr(10), '-', chr(10), '- last', chr(10), '## [1.', doc_id % 20, '.3] - d', chr(10), ' n', doc_id, chr(10), coalesce(text, ''), chr(10), '## [0.1.0]', chr(10), 'end') AS content,
  concat('1.', doc_id % 20, '.3') AS version, concat(CASE WHEN doc_id % 2 = 0 THEN 'v' ELSE '' END, CASE WHEN doc_id % 9 = 0 THEN '7.7.7' ELSE concat('1.', doc_id % 20, '.3') END) AS tag FROM {documents}"""


def release_texts(spark, d):
    """A changelog around every whole document: what is unreleased, which version follows, and notes of a tag."""
    r = I.load(spark, d, _RELEASES).withColumn("e", C.unreleased_entries(F.col("content"))).withColumn("bump", C.version_bump(F.col("e")))
    n = F.when(F.col("e").isNotNull(), F.size("e"))
    said = F.array_join(F.transform("e", lambda e: F.concat_ws(": ", e["part"], e["entry"])), "|")
    return r.select("doc_id", n.alias("n_entries"), said.alias("entries"), "bump", C.next_version(F.col("version"), F.col("bump")).alias("next_version"), C.release_notes(F.col("content"), F.col("tag")).alias("notes"))


def message_texts(spark, d):
    """Every turn in one of seven shapes of a message document, flattened again."""
    c = I.load(spark, d, "SELECT conv_id, turn, text FROM {conversations}")
    t, item = F.col("text"), F.struct("text")
    other = F.struct(F.lit(None).cast("string").alias("text"))
    nested = F.struct(F.struct(F.array(item).alias("content")).alias("message"))
    shapes = [F.to_json(item), F.to_json(F.struct(t.alias("content"))), F.to_json(F.struct(F.array(item, other, item).alias("content"))), F.to_json(nested), F.concat(F.lit("["), F.to_json(item), F.lit(',"end",7]')), F.to_json(F.struct(F.struct(t.alias("content")).alias("message"))), F.lit("oops")]
    json = F.element_at(F.array(*shapes), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    return c.select("conv_id", "turn", A.message_text(json).alias("said"))


def evaluation_report(spark, d):
    """The report's section on every session, with the time stamp of its file."""
    log = I.load(spark, d, I.LOG)
    each = log.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tool_name"))), lambda x: x["tool_name"]).alias("tools"))
    started = I.load(spark, d, "SELECT user_id AS session_id, ts FROM {events}").groupBy("session_id").agg(F.min("ts").cast("timestamp").alias("ts"))
    m = C.verdict(C.tool_metrics(log).withColumn("final_answer", F.when(F.col("session_id") % 9 == 0, " ").otherwise(" done ")))
    name = F.concat(F.lit("Session "), F.col("session_id").cast("string"))
    rows = m.join(each, "session_id").join(started, "session_id").withColumn("title", name).withColumn("prompt", F.lower("title"))
    iso = A.iso_text(F.col("ts"))
    return rows.select("session_id", iso.alias("started"), A.file_stamp(iso).alias("stamp"), A.session_section().alias("section"))


def failure_report(spark, d):
    """Failure cases held against what came: every first turn as a provider's message."""
    c = I.load(spark, d, _MESSAGES)
    blocked, code = F.lit(S.MESSAGES["BLOCKED"]), S.failure_code(F.col("message"))
    hoped = F.when(F.col("conv_id") % 6 < 4, "BLOCKED").otherwise("FETCH_FAILED")
    plain = F.concat(F.lit("DuckDuckGo search request failed: "), F.col("message"))
    cases = c.select("conv_id", F.concat(F.lit("case "), F.col("conv_id").cast("string")).alias("title"), hoped.alias("expected_code"), code.alias("actual_code"), blocked.alias("expected_message"), F.when(code == "BLOCKED", blocked).otherwise(plain).alias("actual_message"))
    out = A.judge_failures(cases)
    return out.select("conv_id", "verdict", A.failure_section().alias("section"))


def evaluation_runs(spark, d):
    """One report for each five sessions and the failure cases of five hundred conversations: Markdown and JSON."""
    told, log = evaluation_report(spark, d), I.load(spark, d, I.LOG)
    m = C.verdict(C.tool_metrics(log).withColumn("final_answer", F.when(F.col("session_id") % 9 == 0, " ").otherwise(" done ")))
    sessions = told.join(m.select("session_id", "verdict"), "session_id").select(F.floor(F.col("session_id") / 5).cast("long").alias("run_id"), F.col("session_id").alias("at"), "section", "verdict", "started")
    runs = sessions.groupBy("run_id").agg(F.min("started").alias("started"), F.max("started").alias("finished")).withColumn("place", F.concat(F.lit("/runs/"), F.col("run_id").cast("string")))
    failures = failure_report(spark, d).filter("conv_id % 3 = 0").select(F.floor(F.col("conv_id") / 500).cast("long").alias("run_id"), F.col("conv_id").alias("at"), "section", "verdict")
    return A.run_reports(runs, sessions.drop("started"), failures)


_MESSAGES = "SELECT conv_id, concat(text, CASE conv_id % 6 WHEN 0 THEN ' HTTP 429' WHEN 1 THEN ' Request BLOCKED' WHEN 2 THEN ' solve the Captcha' WHEN 3 THEN ' rate-limit' WHEN 4 THEN ' time-out' ELSE '' END) AS message FROM {conversations} WHERE turn = 0"


def failure_code(spark, d):
    """The code of a search that failed, by its message: every first turn, with what a provider may say behind it."""
    return I.load(spark, d, _MESSAGES).select("conv_id", S.failure_code(F.col("message")).alias("code"))


def tool_call_times(spark, d):
    """Every call with its end. The events are dealt by session first, so that all windows below share one shuffle whose
    tasks hold about as many rows however large the table is."""
    events = dealt(spark.read.parquet(f"{d}/events.parquet"), "user_id")
    return C.timed_calls(I.load(spark, d, I.CALLS, events=events))


_CHANGELOG = "SELECT n_nationkey AS log_id, concat('# Log', chr(10), '## [1.', n_nationkey % 4, '.0] - x', chr(10), '- a', chr(10), chr(10), '## Unreleased', chr(10), '- b', chr(13), chr(10), '## 0.9.', n_nationkey, chr(10), '- c') AS content FROM {nation}"


def changelog_sections(spark, d):
    return C.changelog_sections(I.load(spark, d, _CHANGELOG)).withColumn("newer", C.is_newer(F.col("version"), F.lit("0.9.10"))).select("log_id", "version", "content", "newer")


_INSTALLED = "SELECT n_nationkey AS log_id, concat('1.', n_nationkey % 5, '.0') AS version, CASE n_nationkey % 4 WHEN 0 THEN '0.9.3' WHEN 1 THEN '1.2.0' WHEN 2 THEN '0.0.1' END AS seen FROM {nation}"


def update_notice(spark, d):
    return C.update_notice(I.load(spark, d, _CHANGELOG), I.load(spark, d, _INSTALLED))


def _accesses(events: DataFrame) -> DataFrame:
    """The key is its parts as JSON, so unlike parts never share one; null where a part is."""
    key = F.when(F.col("user_id").isNotNull() & F.col("event_type").isNotNull(), F.to_json(F.array(F.col("user_id").cast("string"), "event_type")))
    return events.select(key.alias("key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def ttl_cache_hits(spark, d):
    return cache_hits(_accesses(spark.read.parquet(f"{d}/events.parquet")), TTL_MS)


def ttl_cache_stream(spark, d):
    """The same through Structured Streaming, from the event files to a table in the shared folder.

    When all files are read, the stream goes on from its checkpoint with one more file: a row without a key, far in the
    future. It is no access, but lets the watermark pass all others.
    """
    folder = f"{shared_dir(spark)}/ttl-{uuid.uuid4().hex}"
    files = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 64)
    last = _accesses(spark.read.parquet(f"{d}/events.parquet")).agg(F.max("ms").alias("ms"))
    end = last.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("event_id"), (F.col("ms") + 100 * TTL_MS).alias("ms"))
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, provider)
        for more in (end.limit(0), end):
            more.write.mode("append").parquet(f"{folder}/end")
            ends = spark.readStream.schema("key string, event_id long, ms long").parquet(f"{folder}/end")
            hits = stream_cache_hits(_accesses(files.parquet(f"{d}/events*.parquet")).unionByName(ends), TTL_MS, delay="1 hour")
            hits.writeStream.format("parquet").option("path", f"{folder}/hits").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema("key string, event_id long, hit boolean").parquet(f"{folder}/hits")


QUERIES = {f.__name__: f for f in (
    page_profile, url_canonical, url_dedupe, host_counts, direct_urls, source_profile, html_title, html_fallback_text, html_readable, entity_decode,
    rendered_cleanup, word_excerpt, fetch_status, query_plan, important_words, serp_parse_json, serp_outcome, redirect_unwrap,
    fanout_merge, fanout_auto, fanout_providers, fanout_weak, search_fallback, fetch_fallback, candidate_topk, evidence_rank,
    evidence_quality, explore_answers, explore_evidence, explore_views, search_views, fetch_views, reader_route, thread_text,
    repo_listing, tool_call_verdict, tool_call_times, config_merge, presentation_modes, scrape_outcome, reader_resolve, fanout_passes,
    failure_code, search_tool, settings_url, repo_read, config_override, config_summary, release_texts, message_texts, evaluation_report, evaluation_runs,
    failure_report, changelog_sections, update_notice, provider_search, backend_sets, health_report,
    config_runs, config_status, config_store, ttl_cache_hits, ttl_cache_stream,
)}
