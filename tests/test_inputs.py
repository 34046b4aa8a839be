"""The inputs hold every row of the tables whole, besides the rows that are added for the branches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foragelake.functions import html as H
from foragelake.functions import text as T
from foragelake.plans import inputs as I
from foragelake.plans.queries import QUERIES
from tests.conftest import SF


@pytest.mark.parametrize(
    ("text", "name", "columns", "keep"),
    [
        (I.URLS, "pages", {"page_id": "page_id", "url": "url"}, "true"),
        (I.HTML, "pages", {"page_id": "page_id", "url": "url", "html": "html"}, "true"),
        (I.QUESTIONS, "conversations", {"conv_id": "query_id", "text": "query"}, "turn = 0"),
    ],
)
def test_every_row_is_read_whole(spark, text, name, columns, keep):
    wanted = spark.read.parquet(f"{SF}/{name}.parquet").filter(keep).select(*[F.col(a).alias(b) for a, b in columns.items()])
    found = I.load(spark, SF, text).select(*columns.values())
    assert wanted.count() > 0 and wanted.exceptAll(found).count() == 0
    ids = found.select(next(iter(columns.values())))
    assert ids.distinct().count() == ids.count()


def test_every_provider_finds_every_page(spark):
    urls = I.load(spark, SF, I.URLS)
    serp = I.load(spark, SF, I.SERP, urls=urls)
    for r in serp.groupBy("provider").agg(F.collect_set(F.rtrim("url", F.lit("/"))).alias("urls")).collect():
        assert {u["url"].rstrip("/") for u in urls.filter(F.col("page_id") < I.EXTRA).collect()} <= set(r["urls"])
    assert serp.filter("url LIKE 'not a url%'").count() > 0


def test_every_crawled_page_has_its_profile(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = QUERIES["page_profile"](spark, SF).select("page_id", "title", "summary")
    text = H.text(F.col("html"))
    wanted = pages.select("page_id", H.title(F.col("html")).alias("title"), T.summary(text).alias("summary"))
    assert wanted.exceptAll(found).count() == 0
