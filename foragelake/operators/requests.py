"""Requests to search providers and to a scraping service, as rows, and what their answers come to.

Nothing is sent here: a job that has a network sends the rows, and sources/recorded.py keeps and replays the answers. No
row holds a key, only the name of the header that takes it and what stands before the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foragelake.functions.standard import standard
from foragelake.functions.text import let, trim
from foragelake.operators.search import SHAPES

# Addresses, headers and parameters of the services, their names and the variables that hold their keys.
ENDPOINTS = {
    "brave": ("GET", "https://api.search.brave.com/res/v1/web/search", "X-Subscription-Token", ""),
    "exa": ("POST", "https://api.exa.ai/search", "x-api-key", ""),
    "tavily": ("POST", "https://api.tavily.com/search", "Authorization", "Bearer "),
    "youcom": ("POST", "https://api.you.com/v1/agents/search", "X-API-Key", ""),
}
MOST_FIELD = {"exa": "numResults", "tavily": "max_results", "youcom": "max_results"}
MOST = 10
NAMES = {"searxng": "SearXNG", "brave": "Brave", "exa": "Exa", "tavily": "Tavily", "youcom": "You.com"}
KEYS = {"brave": "PI_WEB_AGENT_BRAVE_API_KEY", "exa": "EXA_API_KEY", "tavily": "TAVILY_API_KEY", "youcom": "YDC_API_KEY"}
NO_BASE_URL = "SearXNG search provider requires backends.search.baseUrl"


def _by(provider: Column, values: dict[str, Column | str]) -> Column:
    out = None
    for name, value in values.items():
        c = F.lit(value) if isinstance(value, str) else value
        out = F.when(provider == name, c) if out is None else out.when(provider == name, c)
    return out


def service_url(base_url: Column, path: str) -> Column:
    """An absolute path on the host of a base URL; null unless that is an http(s) URL."""
    return F.concat(F.regexp_extract(standard(base_url), r"^([^/]*//[^/?#]*)", 1), F.lit(path))


def _quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]\z", 1)


def search_request(provider: Column, query: Column, base_url: Column, options: Column, has_key: Column) -> Column:
    """Struct (method, url, key_header, key_prefix, body, code, message) of a search.

    options: struct (categories, language, safesearch), for searxng. A blank query, a missing key or a missing base URL
    gives code and message and nothing to send.
    """

    def build(x: Column) -> Column:
        o, q = x["o"], F.url_encode(x["q"])
        own = [
            F.concat(F.lit("q="), q, F.lit("&format=json")),
            F.when(F.size(o["categories"]) > 0, F.concat(F.lit("categories="), F.url_encode(F.array_join(o["categories"], ",")))),
            F.when(o["language"] != "", F.concat(F.lit("language="), F.url_encode(o["language"]))),
            F.when(o["safesearch"].isNotNull(), F.concat(F.lit("safesearch="), o["safesearch"].cast("string"))),
        ]
        urls = {"searxng": F.concat(service_url(x["base"], "/search"), F.lit("?"), F.concat_ws("&", *own)), "brave": F.concat(F.lit(ENDPOINTS["brave"][1] + "?q="), q)}
        urls |= {p: F.lit(ENDPOINTS[p][1]) for p in MOST_FIELD}
        bodies = {p: F.concat(F.lit('{"query":'), _quoted(x["q"]), F.lit(f',"{field}":{MOST}}}')) for p, field in MOST_FIELD.items()}
        p = x["p"]
        bad = F.when(x["q"] == "", "Query must not be empty.")
        bad = bad.when((p == "searxng") & urls["searxng"].isNull(), NO_BASE_URL)
        bad = bad.when(p.isin(*KEYS) & ~x["key"], F.concat(_by(p, NAMES), F.lit(" search requires "), _by(p, KEYS), F.lit(".")))

        def told(v: Column) -> Column:
            def sent(c: Column) -> Column:
                return F.when(v.isNull(), c)

            return F.struct(
                sent(_by(p, {"searxng": "GET"} | {n: e[0] for n, e in ENDPOINTS.items()})).alias("method"),
                sent(_by(p, urls)).alias("url"),
                sent(_by(p, {n: e[2] for n, e in ENDPOINTS.items()})).alias("key_header"),
                sent(_by(p, {n: e[3] for n, e in ENDPOINTS.items()})).alias("key_prefix"),
                sent(_by(p, bodies)).alias("body"),
                F.when(v.isNotNull(), F.when(x["q"] == "", "INVALID_QUERY").otherwise("BACKEND_CONFIG_INVALID")).alias("code"),
                v.alias("message"),
            )

        return let(bad, told)

    fields = {"p": provider, "q": trim(F.coalesce(query, F.lit(""))), "base": base_url, "o": options, "key": F.coalesce(has_key, F.lit(False))}
    return let(F.struct(*[c.alias(n) for n, c in fields.items()]), build)


def scrape_request(url: Column, base_url: Column, options: Column) -> Column:
    """Struct (method, url, key_header, key_prefix, body) of a scrape; options: struct (formats, only_main)."""
    formats = F.coalesce(F.to_json(options["formats"]), F.lit('["markdown"]'))
    main = F.when(options["only_main"].isNotNull(), F.concat(F.lit(',"onlyMainContent":'), options["only_main"].cast("string"))).otherwise("")
    body = F.concat(F.lit('{"url":'), _quoted(url), F.lit(',"formats":'), formats, main, F.lit("}"))
    return F.struct(F.lit("POST").alias("method"), service_url(base_url, "/v1/scrape").alias("url"), F.lit("Authorization").alias("key_header"), F.lit("Bearer ").alias("key_prefix"), body.alias("body"))


def payload_hits(provider: Column, body: Column) -> Column:
    """Array of (title, url, snippet) of a provider's answer; null if it isn't JSON. Rows without a title or URL are left out."""

    def text(v: Column, field: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        return F.when(kind == "STRING", F.try_variant_get(v, f"$.{field}", "string"))

    def hits(v: Column) -> Column:
        def of(path: str, field: str) -> Column:
            rows = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
            found = F.transform(rows, lambda r: F.struct(text(r, "title").alias("title"), text(r, "url").alias("url"), F.coalesce(text(r, field), F.lit("")).alias("snippet")))
            return F.filter(found, lambda h: h["title"].isNotNull() & h["url"].isNotNull())

        return F.when(v.isNotNull(), _by(provider, {n: of(path, field) for n, (path, field) in SHAPES.items()}))

    return let(F.try_parse_json(body), hits)


def search_answers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (request_id, provider, request: search_request()), responses (request_id, provider, http_status, body,
    failure) -> request_id, provider, status, results, code, message.

    A request that can't be sent says why. One without an answer, with a failure, another status than 2xx or no JSON has
    failed; one without usable rows has no results. Of several answers to a request the one with the smallest (failure,
    status, body) counts; requests that share an id and a provider are answered alike.
    """
    c, none = F.col, F.array().cast("array<struct<title:string,url:string,snippet:string>>")
    said = responses.groupBy("request_id", "provider").agg(F.min(F.struct("failure", "http_status", "body")).alias("a"))
    rows = requests.join(said, ["request_id", "provider"], "left").withColumn("hits", payload_hits(c("provider"), c("a.body")))
    wrong = F.coalesce(c("a.failure"), F.when(c("a.http_status").isNull(), "no answer"), F.when(~c("a.http_status").between(200, 299), F.concat(F.lit("HTTP "), c("a.http_status").cast("string"))), F.when(c("hits").isNull(), "invalid JSON"))
    rows = rows.withColumn("wrong", F.when(c("request.code").isNull(), wrong)).withColumn("name", _by(c("provider"), NAMES))
    code = F.coalesce(c("request.code"), F.when(c("wrong").isNotNull(), "FETCH_FAILED").when(F.size("hits") == 0, "NO_RESULTS"))
    message = F.coalesce(c("request.message"), F.when(c("wrong").isNotNull(), F.concat("name", F.lit(" search request failed: "), "wrong")).when(F.size("hits") == 0, F.concat("name", F.lit(" returned no usable results for this query."))))
    return rows.select("request_id", "provider", F.when(code.isNull(), "ok").otherwise("error").alias("status"), F.when(code.isNull(), c("hits")).otherwise(none).alias("results"), code.alias("code"), message.alias("message"))
