"""Special readers: which URL goes to which, and how their texts are put together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foragelake.functions.html import READER_CAP
from foragelake.functions.text import collapse, cut, let, trim
from foragelake.functions.standard import standard
from foragelake.functions.urls import full_host_of, host_of, path_of, value_of


def _segments(u: Column) -> Column:
    return F.filter(F.split(path_of(u), "/"), lambda s: s != "")


def repo_shape(url: Column) -> Column:
    """blob, issue, pull or repo-root of a repository host's URL; null for others."""
    return let(standard(url), _shape_of)


def _shape_of(u: Column) -> Column:
    def shape(s: Column) -> Column:
        kind, n = F.get(s, F.lit(2)), F.size(s)
        return F.when((n >= 5) & (kind == "blob"), F.lit("blob")).when((n >= 4) & (kind == "issues"), F.lit("issue")).when((n >= 4) & (kind == "pull"), F.lit("pull")).when(n == 2, F.lit("repo-root"))

    return F.when(full_host_of(u) == "github.com", let(_segments(u), shape))


def encode_segment(c: Column) -> Column:
    """Percent-encodes once, what is encoded already included."""
    plain = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    out = F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20"))
    # Marks that scripts leave bare.
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def raw_url(url: Column) -> Column:
    return let(standard(url), _raw_of)


def _raw_of(u: Column) -> Column:
    s = _segments(u)
    names = F.transform(F.slice(s, 4, F.greatest(F.size(s) - 3, F.lit(0))), encode_segment)
    raw = F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(s, F.lit(0)), F.lit("/"), F.get(s, F.lit(1)), F.lit("/"), F.array_join(names, "/"))
    return F.when(_shape_of(u) == "blob", raw)


def thread_text(body: Column, comments: Column) -> Column:
    parts = F.concat(F.array(F.coalesce(body, F.lit(""))), F.transform(comments, lambda c: F.coalesce(c, F.lit(""))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n---\n\n")


def listing(readme: Column, entries: Column) -> Column:
    """README and the entries (name, type) of a repository."""
    lines = F.transform(entries, lambda e: F.concat(F.when(e["type"] == "dir", F.lit("[dir] ")).otherwise(F.lit("")), e["name"]))
    return F.concat(readme, F.lit("\n\nTop-level contents:\n"), F.array_join(lines, "\n"))


def is_pdf(url: Column) -> Column:
    return let(standard(url), _pdf_of)


def _pdf_of(u: Column) -> Column:
    return F.coalesce(F.endswith(F.lower(F.when(host_of(u).isNotNull(), path_of(u))), F.lit(".pdf")), F.lit(False))


def pdf_title(url: Column, found: Column) -> Column:
    name = let(standard(url), lambda u: F.try_element_at(_segments(u), F.lit(-1)))
    return F.coalesce(F.nullif(trim(found), F.lit("")), F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), F.lit("PDF"))


def video_id(url: Column) -> Column:
    return let(standard(url), _video_of)


def _video_of(u: Column) -> Column:
    seen = F.struct(host_of(u).alias("h"), path_of(u).alias("p"), _segments(u).alias("s"), value_of(u, "v").alias("v"))

    def pick(x: Column) -> Column:
        first = F.get(x["s"], F.lit(0))
        named = F.when(first.isin("shorts", "live", "embed"), F.get(x["s"], F.lit(1)))
        full = F.when(x["p"] == "/watch", x["v"]).otherwise(named)
        return F.when(x["h"] == "youtu.be", first).when(x["h"] == "youtube.com", full)

    return let(seen, pick)


def transcript(lines: Column) -> Column:
    return collapse(F.array_join(lines, " "))


def capped(c: Column) -> Column:
    return cut(c, READER_CAP)


def is_truncated(c: Column) -> Column:
    return F.length(c) >= READER_CAP


def resolve(url: Column, status: Column, content_type: Column) -> Column:
    """The reader that answers: that of the URL, or, where a plain read is told an unsupported type, that of the type."""
    by_url = route(url)
    by_type = (by_url == "http") & (status == "unsupported") & F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))
    return F.when(by_type, F.lit("pdf")).otherwise(by_url)


def route(url: Column) -> Column:
    """The first reader that takes a URL: github, pdf, youtube, else http; unsupported without http(s)."""

    # Most URLs are none of these, and a look at host and ending tells; only the others are taken apart.
    def first(x: Column) -> Column:
        u, h = x["u"], x["h"]
        repo, pdf, video = h == "github.com", u.rlike(r"(?i)(?:\.|%2e)pdf"), h.isin("youtu.be", "youtube.com", "www.youtu.be", "www.youtube.com")
        special = F.when(repo & _shape_of(u).isNotNull(), F.lit("github")).when(pdf & _pdf_of(u), F.lit("pdf")).when(video & _video_of(u).isNotNull(), F.lit("youtube"))
        return special.when(url.rlike("^https?://"), F.lit("http")).otherwise(F.lit("unsupported"))

    return let(standard(url), lambda u: let(F.struct(u.alias("u"), full_host_of(u).alias("h")), first))


def repo_outcome(url: Column, target: Column, http_status: Column, title: Column, body: Column, failure: Column) -> Column:
    """Struct (status, url, title, text, truncated, code, message) of reading a repository's page through `target`.

    failure is what went wrong before an answer came; a status that isn't 2xx, or none, is one too.
    """
    where = F.when(F.contains(target, F.lit("://api.")), F.lit("GitHub API returned ")).otherwise(F.lit("GitHub returned "))
    told = F.when(~http_status.between(200, 299), F.concat(where, http_status.cast("string"), F.lit(" for "), target)).when(http_status.isNull(), "GitHub read failed.")
    bad = F.when(repo_shape(url).isNull(), "Unsupported GitHub URL shape for the reader.").otherwise(F.coalesce(failure, told))

    def build(x: Column) -> Column:
        good, said = x["bad"].isNull(), F.coalesce(x["body"], F.lit(""))
        return F.struct(
            F.when(good, "ok").otherwise("error").alias("status"),
            x["url"].alias("url"),
            F.when(good, x["title"]).alias("title"),
            F.when(good, capped(said)).alias("text"),
            (good & is_truncated(said)).alias("truncated"),
            F.when(~good, "GITHUB_FETCH_FAILED").alias("code"),
            x["bad"].alias("message"),
        )

    return let(F.struct(bad.alias("bad"), url.alias("url"), title.alias("title"), body.alias("body")), build)
