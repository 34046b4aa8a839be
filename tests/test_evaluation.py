"""Configuration overrides, message documents, releases, failure cases and the composed search on odd rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from foragelake.functions import readers, urls
from foragelake.operators import config as B
from foragelake.operators import evaluation as A
from foragelake.operators import records as C
from foragelake.operators import search as S
from foragelake.plans import inputs as I
from foragelake.plans.queries import QUERIES
from tests.conftest import SF
from tests.test_functions import one


def test_an_override_over_what_it_inherits_gives_the_whole_again(spark):
    """Also through JSON: what config_override says is read as a layer of its own."""
    c = I.load(spark, SF, I.CONFIGS).join(QUERIES["config_override"](spark, SF), "config_id")
    own, project = B.parse_backends(F.col("own")), B.parse_backends(F.col("project"))
    names = {"base_url": "baseUrl", "only_main": "onlyMainContent"}
    said = F.concat(F.lit('{"backends":'), F.col("backends"), F.lit("}"))
    for ours, theirs in names.items():
        said = F.replace(said, F.lit(f'"{ours}"'), F.lit(f'"{theirs}"'))
    over = F.from_json("backends", f"search {B.SEARCH}, fetch {B.FETCH}")
    rows = c.select(B.merge_backends(own, project).alias("whole"), B.merge_backends(own).alias("i"), B.merge_backends(own, over).alias("again"), over.alias("over"), said.alias("said")).distinct().collect()
    assert len(rows) > 20
    for r in rows:
        whole, again = r["whole"].asDict(True), r["again"].asDict(True)
        whole["fetch"]["api_key"] = again["fetch"]["api_key"] = None
        assert whole == again
        assert "api_key" not in r["said"]
        if r["whole"] == r["i"]:
            assert r["over"]["search"] is None and r["over"]["fetch"] is None
    assert any(r["over"]["search"] is None for r in rows) and any(r["over"]["search"] is not None for r in rows)


def test_a_presentation_override_leaves_out_what_holds_anyway(spark):
    own = '{"presentation":{"defaultMode":"verbose","tools":{"web_search":{"mode":"verbose"},"web_fetch":{"mode":"preview"},"other":{"mode":"preview"}}}}'
    for below, default, tools in (("{}", "verbose", {"web_search": "verbose", "web_fetch": "preview"}), ('{"presentation":{"defaultMode":"verbose"}}', None, {"web_fetch": "preview"}), (None, "verbose", {"web_search": "verbose", "web_fetch": "preview"})):
        row = spark.createDataFrame([(own, below)], "own string, below string")
        got = row.select(B.presentation_override(C.WEB_TOOLS, B.parse_presentation(F.col("own")), B.parse_presentation(F.col("below"))).alias("o")).first()["o"]
        assert got["default_mode"] == default and got["tools"] == tools


@pytest.mark.parametrize(
    ("document", "wanted"),
    [
        ("hi", "hi"),
        (["a", {"text": "b"}, 5, None, "", ["c", ["d"]]], "a\nb\nc\nd"),
        ({"text": "t", "content": "c"}, "t"),
        ({"text": 5, "content": "c"}, "c"),
        ({"content": [{"text": "a"}, "b", {"text": 5}, {"text": "c"}], "message": {"content": [{"text": "no"}]}}, "a\nc"),
        ({"message": {"text": "m", "content": []}}, "m"),
        ({"message": {"content": "m"}}, ""),
        (5, ""),
        (None, ""),
        ({}, ""),
    ],
)
def test_message_text(spark, document, wanted):
    assert one(spark, json.dumps(document), A.message_text) == wanted


def test_message_text_of_no_document(spark):
    assert one(spark, None, A.message_text) == "" and one(spark, "no json", A.message_text) == ""


def test_times(spark):
    row = spark.sql("SELECT timestamp '2024-02-03 04:05:06.7' AS t")
    iso = A.iso_text(F.col("t"))
    assert tuple(row.select(iso, A.file_stamp(iso)).first()) == ("2024-02-03T04:05:06.700Z", "2024-02-03T04-05-06-700Z")


def test_failures(spark):
    rows = [("a", "X", "X", "m", "m"), ("b", "X", "Y", "m", None), ("c", None, None, None, None)]
    out = A.judge_failures(spark.createDataFrame(rows, "title string, expected_code string, actual_code string, expected_message string, actual_message string"))
    got = {r["title"]: (r["verdict"], r["notes"]) for r in out.collect()}
    assert got == {"a": ("pass", []), "b": ("fail", ["expected code X but got Y", 'expected message "m" but got "null"']), "c": ("pass", [])}


def test_releases(spark):
    log = "# L\n## Unreleased\n### Added\n- one\n-   two \n\n### Other\n- three\n### Fixed\r\n - None.\r\n## [1.0.0] - x\n\n body\n### Added\n- old\n## [0.9.0]\nlast"
    said = one(spark, log, C.unreleased_entries)
    assert [tuple(e) for e in said] == [("Added", "one"), ("Added", "two"), ("Added", "three")]
    assert one(spark, log, lambda x: C.version_bump(C.unreleased_entries(x))) == "minor"
    assert one(spark, log, lambda x: C.release_notes(x, F.lit("v1.0.0"))) == "body\n### Added\n- old"
    assert one(spark, log, lambda x: C.release_notes(x, F.lit("0.9.0"))) == "last"
    assert one(spark, log, lambda x: C.release_notes(x, F.lit("v2.0.0"))) is None
    assert one(spark, "# nothing", C.unreleased_entries) is None and one(spark, None, C.unreleased_entries) is None
    assert one(spark, "## Unreleased", C.unreleased_entries) == []
    bumps = [one(spark, v, lambda x: C.next_version(x, F.lit(b))) for v, b in (("1.2.3", "major"), ("1.2.3", "minor"), ("1.2.3", "patch"), ("1.2", "patch"), (None, "major"))]
    assert bumps == ["2.0.0", "1.3.0", "1.2.4", None, None]


def test_settings_url(spark):
    for raw, ok, value in (("  HTTP://A.com:80/ ", True, "http://a.com"), ("https://a.com/x/?utm_source=1#f", True, "https://a.com/x/?utm_source=1#f"), ("a.com", False, None), ("", False, None), (None, False, None)):
        got = one(spark, raw, urls.settings_url)
        assert got["ok"] == ok and got["value"] == value and (got["message"] is None) == ok


def test_repo_outcome(spark):
    rows = [("https://github.com/a/b", 200, "x" * 24_001, None), ("https://github.com/a/b", 404, None, None), ("https://github.com/a/b", None, None, "down"), ("https://github.com/a", 200, "x", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "url string, s int, body string, failure string")
    got = df.select(readers.repo_outcome(F.col("url"), F.lit("https://api.github.com/r"), F.col("s"), F.lit("T"), F.col("body"), F.col("failure")).alias("r")).collect()
    assert [r["r"]["message"] for r in got] == [None, "GitHub API returned 404 for https://api.github.com/r", "down"] + ["Unsupported GitHub URL shape for the reader."] * 2
    assert len(got[0]["r"]["text"]) == 24_000 and got[0]["r"]["truncated"] and got[1]["r"]["code"] == "GITHUB_FETCH_FAILED"


def test_keyless_search_on_odd_rows(spark):
    page = '<div class="result"><a class="result__a" href="https://a/">T</a></div>'
    asked = spark.createDataFrame([(1, " q ", 0), (2, "q", 10), (3, "q", 30_000), (4, None, 5), (5, "q", None), (6, "gone", 0), (7, "bad", 0), (8, "bad", 1)], "request_id long, query string, ms long")
    told = spark.createDataFrame([("q", page, None), ("q", page, None), ("bad", None, "Rate limit")], "query string, html string, failure string")
    got = {r["request_id"]: (r["code"], r["cache_hit"], len(r["results"])) for r in S.keyless_search(asked, told).collect()}
    assert got == {1: (None, False, 1), 2: (None, True, 1), 3: (None, False, 1), 4: ("INVALID_QUERY", False, 0), 5: (None, False, 1), 6: ("FETCH_FAILED", False, 0), 7: ("BLOCKED", False, 0), 8: ("BLOCKED", False, 0)}
    assert S.keyless_search(asked.limit(0), told.limit(0)).count() == 0


def test_lists_in_lists_at_any_depth_keep_their_text(spark):
    deep = "x"
    for _ in range(40):
        deep = [deep, []]
    docs = [deep, [[["a", [{"text": "b"}, ["c", [], ""]]]], "d"], [{"content": [{"text": "e"}, {"text": 5}]}, [[{"message": {"content": [{"text": "f"}]}}]]], [], [[[]]]]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string")
    found = {r["i"]: r["t"] for r in rows.select("i", A.message_text(F.col("j")).alias("t")).collect()}
    assert found == {0: "x", 1: "a\nb\nc\nd", 2: "e\nf", 3: "", 4: ""}
