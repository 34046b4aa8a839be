"""Recorded answers, configuration files and their store, and requests with the parameters of each service."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from foragelake.operators import config as B
from foragelake.operators.requests import scrape_request, search_answers, search_request
from foragelake.sources.configs import apply_writes, commit_writes, read_store, scan_configs, unchanged_runs
from foragelake.sources.recorded import record, recorded, recorded_stream

ANSWERS = "request_id long, provider string, http_status int, body string, failure string"


def test_recorded_answers_in_batch_and_stream(spark, tmp_path):
    rows = [(i, p, 200, json.dumps({"results": [{"title": f"é\n{i}", "url": "http://a"}]}), None) for i, p in enumerate(["brave", "exa", "exa", "tavily"])]
    rows.append((9, "exa", None, None, "timed out"))
    path = str(tmp_path / "answers")
    record(spark.createDataFrame(rows, ANSWERS), path)
    assert sorted(tuple(r) for r in recorded(spark, path).select("request_id", "provider", "http_status", "body", "failure").collect()) == sorted(rows)
    one = recorded(spark, path).filter("provider = 'exa'")
    assert "PartitionFilters: [isnotnull(provider" in one._jdf.queryExecution().toString() and one.count() == 3
    seen = []
    for more in (None, [(20, "brave", 503, None, None)]):
        if more:
            record(spark.createDataFrame(more, ANSWERS), path)
        job = recorded_stream(spark, path, 1).writeStream.foreachBatch(lambda df, i: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        job.awaitTermination()
    # The second run goes on where the first one stopped.
    assert sum(seen) == len(rows) + 1


OPTIONS = "struct<categories:array<string>,language:string,safesearch:int>"


def request(spark, provider, query, base=None, options=(None, None, None), key=True):
    row = spark.createDataFrame([(provider, query, base, options, key)], f"p string, q string, b string, o {OPTIONS}, k boolean")
    c = F.col
    return row.select(search_request(c("p"), c("q"), c("b"), c("o"), c("k")).alias("r")).first()["r"]


def test_requests_have_the_parameters_of_each_service(spark):
    r = request(spark, "searxng", " a b&c ", "http://s.example:8080/sub", (["news", "it"], "de", 0))
    assert r["url"] == "http://s.example:8080/search?q=a+b%26c&format=json&categories=news%2Cit&language=de&safesearch=0" and r["method"] == "GET"
    assert request(spark, "searxng", "q", "https://s.example", ([], "", None))["url"] == "https://s.example/search?q=q&format=json"
    assert request(spark, "brave", "é")["url"] == "https://api.search.brave.com/res/v1/web/search?q=%C3%A9"
    r = request(spark, "exa", 'say "hi"\n')
    assert (r["method"], r["key_header"], json.loads(r["body"])) == ("POST", "x-api-key", {"query": 'say "hi"', "numResults": 10})
    assert json.loads(request(spark, "tavily", "q")["body"]) == {"query": "q", "max_results": 10}
    assert json.loads(request(spark, "youcom", "q")["body"]) == {"query": "q", "max_results": 10}
    assert tuple(request(spark, "exa", "q", key=False))[-2:] == ("BACKEND_CONFIG_INVALID", "Exa search requires EXA_API_KEY.")
    assert request(spark, "searxng", "q", "no url")["code"] == "BACKEND_CONFIG_INVALID" and request(spark, "exa", " ", key=False)["code"] == "INVALID_QUERY"
    made = spark.sql("SELECT 'http://p/?a=\"' AS url, 'https://f.example/x' AS base, named_struct('formats', array('html'), 'only_main', true) AS o, CAST(NULL AS STRUCT<formats: ARRAY<STRING>, only_main: BOOLEAN>) AS n")
    a, b = made.select(scrape_request(F.col("url"), F.col("base"), F.col("o")).alias("a"), scrape_request(F.col("url"), F.col("base"), F.col("n")).alias("b")).first()
    assert a["url"] == "https://f.example/v1/scrape" and json.loads(a["body"]) == {"url": 'http://p/?a="', "formats": ["html"], "onlyMainContent": True}
    assert json.loads(b["body"]) == {"url": 'http://p/?a="', "formats": ["markdown"]}


def test_answers(spark):
    asked = spark.createDataFrame([(i, "brave", "q") for i in range(6)] + [(6, "brave", " "), (1, "brave", "q")], "request_id long, provider string, q string")
    asked = asked.select("request_id", "provider", search_request(F.col("provider"), F.col("q"), F.lit(None).cast("string"), F.lit(None).cast(OPTIONS), F.lit(True)).alias("request"))
    body = json.dumps({"web": {"results": [{"title": "T", "url": "u", "description": 5}, {"title": 1, "url": "u"}]}})
    answers = [(0, "brave", 200, body, None), (0, "brave", 200, body, None), (1, "brave", 429, body, None), (2, "brave", 200, "oops", None), (3, "brave", 200, "{}", None), (4, "brave", None, None, "reset"), (6, "brave", 200, body, None), (7, "brave", 200, body, None)]
    found = search_answers(asked, spark.createDataFrame(answers, ANSWERS)).collect()
    told = sorted((r["request_id"], r["status"], r["code"] or "", r["message"] or "", [tuple(h) for h in r["results"]]) for r in found)
    failed = "Brave search request failed: "
    assert told == [
        (0, "ok", "", "", [("T", "u", "")]), (1, "error", "FETCH_FAILED", failed + "HTTP 429", []), (1, "error", "FETCH_FAILED", failed + "HTTP 429", []), (2, "error", "FETCH_FAILED", failed + "invalid JSON", []),
        (3, "error", "NO_RESULTS", "Brave returned no usable results for this query.", []), (4, "error", "FETCH_FAILED", failed + "reset", []), (5, "error", "FETCH_FAILED", failed + "no answer", []), (6, "error", "INVALID_QUERY", "Query must not be empty.", []),
    ]


def test_files_are_found_and_told_apart(spark, tmp_path):
    for name, body in (("a", '{"presentation": {"defaultMode": "verbose"}}'), ("b", '{"defaultMode": "preview"}'), ("c", "{ broken"), ("d", "")):
        (tmp_path / "x" / name).mkdir(parents=True)
        (tmp_path / "x" / name / f"{name}.json").write_text(body)
    found = scan_configs(spark, str(tmp_path), spark.createDataFrame([(k,) for k in "abcde"], "key string"))
    modes = found.select("key", "status", B.parse_presentation(F.col("body"))["default_mode"].alias("m")).collect()
    assert sorted(map(tuple, modes), key=str) == [("a", "ok", "verbose"), ("b", "legacy", "preview"), ("c", "malformed", None), ("d", "missing", None), ("e", "missing", None)]


WRITES = "key string, version long, kind string, body string"


def files(df):
    return {r["key"]: (json.loads(r["body"]) if r["body"].startswith("{") and r["body"].endswith("}") else r["body"], r["version"]) for r in df.collect()}


def test_writes_keep_what_stands_beside_them(spark):
    old = spark.createDataFrame([("a", '{"other": [1], "presentation": {"defaultMode": "verbose"}}', 3), ("b", "broken", 1), ("c", '{"x": 1}', 1), ("d", '{"x": 1}', 9), ("e", '{"y": 2}', 1)], "key string, body string, version long")
    writes = [
        ("a", 4, "presentation", '{"defaultMode": "compact"}'), ("a", 6, "backends", '{"search": {"provider": "exa"}, "fetch": {"provider": "firecrawl", "apiKey": "secret"}}'), ("a", 5, "backends", '{"search": {"provider": "brave"}}'),
        ("b", 2, "presentation", "{}"), ("c", 2, "reset", None), ("d", 4, "presentation", '{"defaultMode": "late"}'), ("f", 1, "presentation", '{"defaultMode": "first"}'), ("f", 2, "reset", None), ("f", 3, "backends", '{"search": {"provider": "exa"}}'),
        ("g", 1, "seen", '{"lastChangelogVersion": "1.2.0"}'), ("g", 2, "seen", '{"lastChangelogVersion": "1.3.0"}'), (None, 1, "seen", "{}"), ("h", 1, "other", "{}"),
    ]
    want = {
        "a": ({"other": [1], "presentation": {"defaultMode": "compact"}, "backends": {"search": {"provider": "exa"}, "fetch": {"provider": "firecrawl"}}}, 6), "b": ("broken", 2),
        "d": ({"x": 1}, 9), "e": ({"y": 2}, 1), "f": ({"backends": {"search": {"provider": "exa"}}}, 3), "g": ({"lastChangelogVersion": "1.3.0"}, 2),
    }
    made = spark.createDataFrame(writes, WRITES)
    assert files(apply_writes(old, made)) == want
    assert files(apply_writes(old, made.unionByName(made).orderBy("body"))) == want
    assert files(apply_writes(old, made.limit(0))).keys() == set("abcde")


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    commit = commit_writes(path)
    batches = [[("a", 1, "presentation", '{"defaultMode": "verbose"}')], [("a", 2, "backends", '{"search": {"provider": "exa"}}'), ("b", 1, "seen", "{}")], [("a", 3, "reset", None)]]
    states = []
    for i, rows in enumerate(batches):
        for _ in range(2):
            commit(spark.createDataFrame(rows, WRITES), i)
            states.append(files(read_store(spark, path)))
    assert states[0] == states[1] == {"a": ({"presentation": {"defaultMode": "verbose"}}, 1)}
    assert states[2] == states[3] == {"a": ({"presentation": {"defaultMode": "verbose"}, "backends": {"search": {"provider": "exa"}}}, 2), "b": ({}, 1)}
    assert states[4] == states[5] == {"b": ({}, 1)}
    # An unfinished snapshot isn't read, and is made anew.
    (tmp_path / "store" / "batch=2" / "_SUCCESS").unlink()
    assert files(read_store(spark, path)) == states[3]
    commit(spark.createDataFrame(batches[2], WRITES), 2)
    assert files(read_store(spark, path)) == states[5]


def test_runs_of_one_configuration(spark):
    log = [(1, p, c) for p, c in enumerate(["a", "a", "b", None, None, "a"])] + [(2, 5, "a")]
    found = unchanged_runs(spark.createDataFrame(log, "session_id long, pos long, config string")).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0, 1, 2), (1, 1, 2, 2, 1), (1, 2, 3, 4, 2), (1, 3, 5, 5, 1), (2, 0, 5, 5, 1)]
