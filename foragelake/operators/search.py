"""Search results: parsing provider payloads, outcomes, merging several providers, fallbacks, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foragelake.functions.tags import SPACE, parse
from foragelake.functions.text import trim, wants_discussion
from foragelake.functions.urls import candidate_scores, canonical, host, unwrap_redirect
from foragelake.streaming.ttl import cache_hits

FANOUT_TIMEOUT_MS, LEAST_RESULTS, MOST_CANDIDATES, SEARCH_TTL_MS = 8000, 3, 4, 30_000

# Where each provider's payload has its rows, and the field that becomes the snippet.
SHAPES = {
    "searxng": ("$.results", "content"),
    "brave": ("$.web.results", "description"),
    "youcom": ("$.results", "snippet"),
    "exa": ("$.results", "text"),
    "tavily": ("$.results", "content"),
}
BLOCKED_PAGE = ("captcha", "challenge", "verify you are human", "are you a robot", "unusual traffic")
BLOCKED_ERROR = ("blocked", "rate limit", "rate-limit", "403", "429", "captcha", "challenge")
MESSAGES = {
    "INVALID_QUERY": "Query must not be empty.",
    "NO_RESULTS": "DuckDuckGo returned no usable results for this query.",
    "BLOCKED": "DuckDuckGo search appears to be blocked or rate limited.",
    "PARSE_FAILED": "DuckDuckGo returned a page, but it did not match the expected results format.",
}
NO_RESULTS = ("no results found", "no more results", "did not match any documents")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """(provider, body, ...) -> + rank, title, url, snippet. Rows whose title or url is no JSON string are dropped."""
    body = F.try_parse_json(F.col("body"))
    rows = None
    for name, (path, _) in SHAPES.items():
        found = F.try_variant_get(body, path, "array<variant>")
        rows = F.when(F.col("provider") == name, found) if rows is None else rows.when(F.col("provider") == name, found)
    out = payloads.withColumn("__rows", rows).select(*payloads.columns, F.posexplode("__rows").alias("rank", "__row"))

    def text(field: str) -> Column:
        v = F.try_variant_get("__row", f"$.{field}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("__row", f"$.{field}", "string"))

    snippet = None
    for name, (_, field) in SHAPES.items():
        snippet = F.when(F.col("provider") == name, text(field)) if snippet is None else snippet.when(F.col("provider") == name, text(field))
    out = out.select(*payloads.columns, "rank", text("title").alias("title"), text("url").alias("url"), F.coalesce(snippet, F.lit("")).alias("snippet"))
    return out.filter("title IS NOT NULL AND url IS NOT NULL").drop("body")


def result_rows(page: str) -> list[tuple[str, str, str]]:
    """(title, href, snippet) of each element of class `result`, from the first link and snippet inside it."""
    tree = parse(page)
    links, snippets = tree.of_class("result__a"), tree.of_class("result__snippet")
    out = []
    for i in tree.of_class("result"):
        a, b = tree.within(i, links), tree.within(i, snippets)
        title = tree.text(a).strip(SPACE) if a is not None else ""
        href = tree.elements[a].attributes.get("href", "").strip(SPACE) if a is not None else ""
        if title and href:
            out.append((title, href, tree.text(b).strip(SPACE) if b is not None else ""))
    return out


_HITS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "snippet")]))


@F.udf(_HITS, useArrow=False)
def _hits(page: str | None) -> list[tuple[str, str, str]] | None:
    return None if page is None else result_rows(page)


def parse_result_page(html: Column) -> Column:
    """Array of (title, url, snippet) of an HTML result page, links of redirects followed; null for null."""
    return F.transform(_hits(html), lambda r: F.struct(r["title"].alias("title"), unwrap_redirect(r["url"]).alias("url"), r["snippet"].alias("snippet")))


def page_outcome(html: Column, n_results: Column) -> Column:
    """ok, NO_RESULTS, BLOCKED or PARSE_FAILED of an HTML result page, in this order."""
    visible = F.lower(F.regexp_replace(html, "<[^>]+>", ""))
    return F.when(n_results > 0, "ok").when(_any(visible, NO_RESULTS), "NO_RESULTS").when(_any(F.lower(html), BLOCKED_PAGE), "BLOCKED").otherwise("PARSE_FAILED")


def failure_code(message: Column) -> Column:
    return F.when(_any(F.lower(message), BLOCKED_ERROR), "BLOCKED").otherwise("FETCH_FAILED")


def keyless_search(requests: DataFrame, answers: DataFrame, ttl_ms: int = SEARCH_TTL_MS) -> DataFrame:
    """requests (request_id, query, ms), answers (query, html, failure) -> request_id, status, results, code, message, cache_hit.

    answers has what the engine says to a trimmed query: a result page, or the message of what failed; the smallest row of
    a query counts. A blank or null query is invalid and asks nothing; a query without an answer has failed. Good answers
    are kept for ttl_ms by query, others are asked for again. Requests without a time are answered past the cache.
    """
    c, none = F.col, F.array().cast("array<struct<title:string,url:string,snippet:string>>")
    said = answers.groupBy(c("query").alias("key")).agg(F.min(F.struct("failure", "html")).alias("a")).select("key", "a.*", F.coalesce(parse_result_page(c("a.html")), none).alias("results"))
    code = F.when(c("failure").isNotNull() | c("html").isNull(), failure_code(F.coalesce("failure", F.lit("")))).otherwise(page_outcome(c("html"), F.size("results")))
    said = said.select("key", "failure", "results", code.alias("code"))
    asked = requests.select("request_id", "ms", trim(F.coalesce("query", F.lit(""))).alias("key"))
    rows = asked.join(said.drop("results"), "key", "left").withColumn("code", F.when(c("key") == "", "INVALID_QUERY").otherwise(F.coalesce("code", F.lit("FETCH_FAILED"))))
    message = F.when(c("code") == "FETCH_FAILED", F.concat(F.lit("DuckDuckGo search request failed: "), F.coalesce("failure", F.lit("Unknown search failure."))))
    for name, text in MESSAGES.items():
        message = message.when(c("code") == name, text)
    good = c("code") == "ok"
    # Requests may share an id, so each carries its own result through the cache instead of being joined to it.
    timed = good & c("ms").isNotNull()
    hits = cache_hits(rows.filter(timed).select("key", c("request_id").alias("event_id"), "ms"), ttl_ms).select("key", c("event_id").alias("request_id"), c("hit").alias("cache_hit"))
    found = hits.unionByName(rows.filter(good & c("ms").isNull()).select("key", "request_id", F.lit(False).alias("cache_hit")))
    found = found.join(said.select("key", "results"), "key").select("request_id", F.lit("ok").alias("status"), "results", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"), "cache_hit")
    return found.unionByName(rows.filter(~good).select("request_id", F.lit("error").alias("status"), none.alias("results"), "code", message.alias("message"), F.lit(False).alias("cache_hit")))


def in_time(serp: DataFrame) -> DataFrame:
    """Rows of providers that answered, in time."""
    return serp.filter((F.col("status") == "ok") & (F.col("latency_ms") <= FANOUT_TIMEOUT_MS))


def merge_providers(serp: DataFrame, *keys: str) -> DataFrame:
    """One row for each canonical URL: keys, pos, title, url, snippet, n_providers, best_rank.

    What more providers found comes first, then the better rank, then what was seen first (by provider_pos, rank). The
    longest title and snippet win, each the first of its length; a provider's repeats of a URL don't count.
    """
    rows = serp.withColumn("key", F.coalesce(canonical(F.col("url")), F.col("url")))
    row = F.struct("title", "url", "snippet")
    own = rows.groupBy(*keys, "key", "provider_pos").agg(F.min_by(row, "rank").alias("r"), F.min("rank").alias("rank"))

    def longest(name: str) -> Column:
        return F.max_by(f"r.{name}", F.struct(F.coalesce(F.length(f"r.{name}"), F.lit(0)), -F.col("provider_pos"), -F.col("rank"))).alias(name)

    first = F.min(F.struct("provider_pos", "rank")).alias("first")
    merged = own.groupBy(*keys, "key").agg(longest("title"), F.min_by("r.url", F.struct("provider_pos", "rank")).alias("url"), longest("snippet"), F.count(F.lit(1)).alias("n_providers"), F.min("rank").alias("best_rank"), first)
    order = Window.partitionBy(*keys).orderBy(F.desc("n_providers"), "best_rank", "first")
    return merged.withColumn("pos", F.row_number().over(order) - 1).select(*keys, "pos", "title", "url", "snippet", "n_providers", "best_rank")


def providers_used(serp: DataFrame, *keys: str) -> DataFrame:
    """keys, providers and skipped (comma-joined, in provider order): who contributed results, and who didn't."""
    good = F.max(((F.col("status") == "ok") & (F.col("latency_ms") <= FANOUT_TIMEOUT_MS) & F.col("url").isNotNull()).cast("int"))
    each = serp.groupBy(*keys, "provider_pos", "provider").agg(F.coalesce(good, F.lit(0)).alias("good"))

    def names(good: int) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("good") == good, F.struct("provider_pos", "provider"))))
        return F.array_join(F.transform(held, lambda x: x["provider"]), ",")

    return each.groupBy(*keys).agg(names(1).alias("providers"), names(0).alias("skipped"))


def providers_over_passes(used: DataFrame, key: str, step: str) -> DataFrame:
    """providers_used() of many passes -> key, providers and skipped in the order in which passes first named them.

    Who contributed in any pass isn't skipped.
    """
    rows = used.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(step, "providers", "skipped"))).alias("u"))

    def names(field: str) -> Column:
        each = F.transform("u", lambda x: F.filter(F.split(x[field], ","), lambda n: n != ""))
        return F.array_distinct(F.flatten(each))

    rows = rows.select(key, names("providers").alias("p"), names("skipped").alias("s"))
    return rows.select(key, F.array_join("p", ",").alias("providers"), F.array_join(F.array_except("s", "p"), ",").alias("skipped"))


def weak_primary(serp: DataFrame, *keys: str) -> DataFrame:
    """keys, n_results, n_hosts, weak: whether the first provider's list is too short or of one host."""
    first = F.col("provider_pos") == 0
    good = first & (F.col("status") == "ok") & (F.col("latency_ms") <= FANOUT_TIMEOUT_MS)
    out = serp.groupBy(*keys).agg(F.count_if(good & F.col("url").isNotNull()).alias("n_results"), F.count_distinct(F.when(good, host(F.col("url")))).alias("n_hosts"))
    return out.withColumn("weak", (F.col("n_results") < LEAST_RESULTS) | (F.col("n_hosts") <= 1))


def auto_merge(serp: DataFrame, *keys: str) -> DataFrame:
    """A strong first provider alone and as it is; otherwise all providers merged."""
    rows = in_time(serp).join(weak_primary(serp, *keys).select(*keys, "weak"), [*keys])
    strong = rows.filter(~F.col("weak") & (F.col("provider_pos") == 0)).select(*keys, F.col("rank").alias("pos"), "title", "url", "snippet", F.lit(1).cast("long").alias("n_providers"), F.col("rank").alias("best_rank"))
    return strong.unionByName(merge_providers(rows.filter("weak"), *keys))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Responses (key, backend, status, message), with the fallback's where the primary failed."""
    failed = F.col("p.status").isin("error", *also)
    both = primary.alias("p").join(fallback.alias("f"), key, "left")
    use = failed & F.col("f.status").isNotNull()
    pick = {x: F.when(use, F.col(f"f.{x}")).otherwise(F.col(f"p.{x}")).alias(x) for x in ("backend", "status", "message")}
    return both.select(key, *pick.values(), F.when(use, F.col("p.backend")).alias("fallback_from"), F.when(use, F.col("p.message")).alias("fallback_reason"))


def url_scores(urls: DataFrame) -> DataFrame:
    """+ plain and talk: the order in which a URL is read, on both scales."""
    return urls.withColumn("__scores", candidate_scores(F.col("url"))).select(*urls.columns, "__scores.plain", "__scores.talk")


def top_candidates(hits: DataFrame, *keys: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """The first hits to read: each URL once (its first row), by score and then position. Needs keys, pos, query.

    Hits that have the columns of url_scores() and whether their query wants a discussion (`discussion`) need no query.
    """
    if "plain" not in hits.columns:
        # Hits are many more than URLs, so each URL is looked at once.
        facts = url_scores(hits.select("url").distinct()).withColumnRenamed("url", "__url")
        hits = hits.join(facts, F.col("url").eqNullSafe(F.col("__url"))).drop("__url")
    if "discussion" not in hits.columns:
        hits = hits.withColumn("discussion", wants_discussion(F.coalesce("query", F.lit(""))))
    rows = hits.select(*keys, "url", "title", "snippet", "pos", F.when(F.col("discussion"), F.col("talk")).otherwise(F.col("plain")).alias("score"))
    # One shuffle for both steps.
    each = rows.repartition(*keys).groupBy(*keys, "url").agg(F.min_by(F.struct("title", "snippet", "score"), "pos").alias("r"), F.min("pos").alias("pos"))
    scored = each.select(*keys, "url", "r.title", "r.snippet", "pos", "r.score")
    order = Window.partitionBy(*keys).orderBy("score", "pos")
    return scored.withColumn("candidate", F.row_number().over(order)).filter(F.col("candidate") <= most)
