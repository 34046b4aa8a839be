"""Edge cases of the functions: nulls, blanks, marks of other scripts, ties and repeated rows."""

from __future__ import annotations

import importlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from foragelake.functions import html, readers, text, urls
from foragelake.operators import evidence
from foragelake.streaming.ttl import cache_hits
from tests.conftest import ROOT


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("https://WWW.a.com/x/?utm_source=1&b=2#f", "https://a.com/x/?b=2"),
        ("http://a.com:80/", "http://a.com"),
        ("https://a.com:8443/x/", "https://a.com:8443/x"),
        ("https://a.com:/x", "https://a.com/x"),
        ("http://u:p@www.a.com/x", "http://u:p@a.com/x"),
        ("http://u@a.com", "http://u@a.com"),
        ("http://:@a.com/", "http://a.com"),
        ("http://[2001:DB8::1]:80/x", "http://[2001:db8::1]/x"),
        ("http://a.com/a/./b/../c/%2e%2E/d", "http://a.com/a/d"),
        ("http://a.com/a/b/..", "http://a.com/a"),
        ("http://a.com/../..", "http://a.com"),
        ("http://a.com/...", "http://a.com/..."),
        ("http://a.com/?q=a%20b&utm%5Fsource=1&flag&x=1=2", "http://a.com/?q=a+b&flag=&x=1%3D2"),
        ("http://a.com/?q=a%20b&flag", "http://a.com/?q=a%20b&flag"),
        ("http://a.com/?UTM_TERM=1&&gclid", "http://a.com"),
        ("http://a.com:x/", None),
        ("http:///x", "http://x"),
        ("ftp://a.com", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical(spark, raw, wanted):
    assert one(spark, raw, urls.canonical) == wanted


def test_direct_urls_keep_order_and_drop_repeats(spark):
    said = "see https://b.com/x), https://a.com/?fbclid=1. https://b.com/x and http://c.d/e! https://e.f"
    assert one(spark, said, urls.direct_urls) == ["https://b.com/x", "https://a.com", "http://c.d/e"]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("&amp;lt;", "&lt;"), ("&#65;&#x42;&NBSP;|", "AB |"), ("&copy; & ;", "&copy; & ;"), ("", ""), (None, None)],
)
def test_entities_are_decoded_once(spark, raw, wanted):
    assert one(spark, raw, html.decode_entities) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("a  　b", 2), ("", None), (" ﻿", None), (None, None)])
def test_word_count(spark, raw, wanted):
    assert one(spark, raw, text.word_count) == wanted


def test_excerpt(spark):
    assert one(spark, "x" * 240, text.excerpt) == "x" * 240
    assert one(spark, "x" * 239 + " y", text.excerpt) == "x" * 239 + "…"
    assert one(spark, "", text.excerpt) is None


def test_conflict_needs_a_recommendation_that_is_not_a_warning(spark):
    assert one(spark, "this is deprecated; x is recommended", text.has_conflict) is True
    assert one(spark, "not recommended", text.has_conflict) is False


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("https://github.com/o/r/blob/main/a%20b/c.md", "github"),
        ("https://a.com/x.PDF", "pdf"),
        ("https://youtu.be/abc", "youtube"),
        ("https://a.com", "http"),
        ("mailto:x", "unsupported"),
    ],
)
def test_route(spark, url, wanted):
    assert one(spark, url, readers.route) == wanted


def test_raw_url_is_encoded_once(spark):
    assert one(spark, "https://github.com/o/r/blob/main/a%20b/(c).md", readers.raw_url) == "https://raw.githubusercontent.com/o/r/main/a%20b/(c).md"


def test_evidence_ties_keep_the_first_place(spark):
    rows = [(1, 0, "a", "u1", "community", "http", "s", "p"), (1, 1, "b", "u2", "community", "http", "s", "p"), (1, 2, "c", "u1", "official-docs", "http", "s", "p"), (1, 2, "c", "u1", "official-docs", "http", "s", "p")]
    df = spark.createDataFrame(rows, "query_id int, ordinal int, title string, url string, source_kind string, method string, summary string, support string")
    found = evidence.rank_evidence(df, "query_id").orderBy("pos").collect()
    assert [(r["url"], r["title"]) for r in found] == [("u1", "c"), ("u2", "b")]
    assert evidence.rank_evidence(df.limit(0), "query_id").count() == 0


def test_cache_window_is_fixed_by_the_miss(spark):
    rows = [("k", 1, 0), ("k", 2, 9), ("k", 3, 10), ("k", 4, 19), ("k", 5, 20), ("z", 6, 5), (None, 7, 5)]
    df = spark.createDataFrame(rows, "key string, event_id long, ms long")
    got = {r["event_id"]: r["hit"] for r in cache_hits(df, 10).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_entry_works_without_the_corpus_operators(tmp_path):
    """What stays when their folders and the pipeline are taken away still imports."""
    for name in ("foragelake", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for p in (ROOT / "foragelake").iterdir():
        if p.name != "llm":
            (tmp_path / "foragelake" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[0]) == len(importlib.import_module("foragelake.plans.queries").QUERIES)


def test_cache_segments_give_what_one_fold_gives(spark):
    """Keys with pauses and without, one of them hot, with ties and repeated rows."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, int(t)) for i, t in enumerate(np.cumsum(rng.choice([0, 1, 3, 9, 10, 11, 40], 600)))]
    rows += rows[:5] + [("k0", None, 3), ("k0", 9999, None)]
    got = sorted((r["key"], r["event_id"] or -1, r["hit"]) for r in cache_hits(spark.createDataFrame(rows, "key string, event_id long, ms long"), 10).collect())
    expires, wanted = {}, []
    for key, event, ms in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], -1 if r[1] is None else r[1])):
        hit = expires.get(key, -1) > ms
        if not hit:
            expires[key] = ms + 10
        wanted.append((key, event or -1, hit))
    assert got == sorted(wanted)
