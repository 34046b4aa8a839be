"""URLs in the form that browsers give them; Punycode against the standard library."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from foragelake.functions import urls as U
from foragelake.functions.standard import punycode, standard

WANTED = {
    "http://a.com/é x": "http://a.com/%C3%A9%20x",
    "http://a.com\\b": "http://a.com/b",
    "http://bücher.de/": "http://xn--bcher-kva.de/",
    "http://BÜCHER.日本語.de": "http://xn--bcher-kva.xn--wgv71a119e.de/",
    "http://0x7f.1/": "http://127.0.0.1/",
    "http://1.2.3/": "http://1.2.0.3/",
    "http://3232235777/": "http://192.168.1.1/",
    "http://0300.0250.1.1./": "http://192.168.1.1/",
    "http://256.1.1.1/": None,
    "http://4294967296/": None,
    "http://1.2.3.4.5/": None,
    "http://09.1/": None,
    "http://a.com:99999/": None,
    "http://a.com:0080/": "http://a.com:80/",
    "https:example.com": "https://example.com/",
    "  https:\\\\ex.com\\a\tb\n": "https://ex.com/ab",
    "http:///x.com/a": "http://x.com/a",
    "http://": None,
    "http://u:p@h.com/": "http://u:p@h.com/",
    "http://u:@h.com/ ": "http://u@h.com/",
    "http://@h.com/": "http://h.com/",
    "http://a@b@c.com/": "http://a%40b@c.com/",
    "http://a b.com/": None,
    "http://%41.com/": "http://a.com/",
    "http://ＥＸ。com/": "http://ex.com/",
    "http://[::1]:80/x": "http://[::1]:80/x",
    "http://a.com?q='x y'": "http://a.com/?q=%27x%20y%27",
    "http://a.com/#é `": "http://a.com/#%C3%A9%20%60",
    "http://a.com/%zz%20{}": "http://a.com/%zz%20%7B%7D",
    "http://a.com/plain?x=1#f": "http://a.com/plain?x=1#f",
    "http://h.com:x/": None,
    "mailto:x@y.com": None,
    "not a url": None,
    "": None,
}


def test_standard(spark):
    rows = spark.createDataFrame([(u,) for u in [*WANTED, None]], "u string")
    assert {r["u"]: r["s"] for r in rows.select("u", standard(F.col("u")).alias("s")).collect()} == {**WANTED, None: None}


def test_punycode(spark):
    rng = random.Random(3)
    labels = {"".join(rng.choice("abcxyz-019üßñéя日本語😀𝒳") for _ in range(rng.randint(1, 20))) for _ in range(300)}
    labels = {x for x in labels if not x.isascii()}
    found = spark.createDataFrame([(x,) for x in labels], "x string").select("x", punycode(F.col("x")).alias("p")).collect()
    assert {r["x"]: r["p"] for r in found} == {x: "xn--" + x.encode("punycode").decode() for x in labels}


def test_functions_read_standard_urls(spark):
    raw = " HTTPS:\\\\WWW.Bücher.de:443\\a b\\..\\é?utm_source=1&q='1'#f "
    c = F.col("u")
    row = spark.createDataFrame([(raw,)], "u string").select(U.canonical(c).alias("canonical"), U.host(c).alias("host"), U.path(c).alias("path"), U.query_value(c, "q").alias("q"), U.settings_url(c)["value"].alias("setting"), U.is_web(c).alias("web")).first()
    assert tuple(row) == ("https://xn--bcher-kva.de/%C3%A9?q=%271%27", "xn--bcher-kva.de", "/%C3%A9", "'1'", "https://www.xn--bcher-kva.de/%C3%A9?utm_source=1&q=%271%27#f", True)
    setting = spark.range(1).select(U.settings_url(F.lit(" http://u:p@s.com/base/ ")).alias("s")).first()["s"]
    assert setting["value"] == "http://u:p@s.com/base"
