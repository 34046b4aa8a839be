"""URL functions as Column expressions: split, canonical form, direct links, host keys and source profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foragelake.functions.standard import standard
from foragelake.functions.text import NOT_WS, let, trim

URL = r"(?i)^(https?)://(?:[^/?#\s]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\s]+)(?::(\d*))?(?=[/?#]|$)([^?#]*)(\?[^#]*)?(#.*)?$"
USER = r"(?i)^https?://([^/?#\s]*@)"
DOTS = r"(?i)/(\.|%2e){1,2}(/|\z)"

# Fixed values.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_name", "fbclid", "gclid")
FORUM_LABELS = "community|forum|forums|discuss|discourse"
FORUM_PATHS = ("/forum/", "/forums/", "/t/", "/topic/", "/threads/")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, URL, i)


def is_web(url: Column) -> Column:
    return F.when(url.isNotNull(), F.coalesce(standard(url).rlike(URL), F.lit(False)))


# Functions named `..._of` take a URL that standard() has given, so that others work it out once.


def full_host_of(u: Column) -> Column:
    return F.when(u.rlike(URL), F.lower(_part(u, 2)))


def host_of(u: Column) -> Column:
    return F.regexp_replace(full_host_of(u), r"^www\.", "")


def path_of(u: Column) -> Column:
    return let(F.coalesce(_part(u, 4), F.lit("")), _resolved)


def value_of(u: Column, key: str) -> Column:
    return F.try_url_decode(F.nullif(F.regexp_extract(_part(u, 5), f"[?&]{key}=([^&]*)", 1), F.lit("")))


def full_host(url: Column) -> Column:
    return let(standard(url), full_host_of)


def _resolved(p: Column) -> Column:
    """A path without dot segments; / for none."""
    plain = F.regexp_replace(p, "(?i)%2e", ".")
    parts = F.split(plain, "/")

    def step(held: Column, x: Column) -> Column:
        return F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, x))

    kept = F.aggregate(F.slice(parts, 2, 1 << 20), F.array().cast("array<string>"), step)
    # A dot segment at the end leaves a slash there.
    end = F.when(plain.rlike(r"/\.{1,2}\z") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(p == "", F.lit("/")).when(p.rlike(DOTS), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(p)


def path(url: Column) -> Column:
    return let(standard(url), path_of)


def host(url: Column) -> Column:
    """Lower-case host without a leading www; null where the URL can't be read."""
    return let(standard(url), host_of)


def host_or_url(url: Column) -> Column:
    return F.coalesce(host(url), F.lower(url))


def query_value(url: Column, key: str) -> Column:
    return let(standard(url), lambda u: value_of(u, key))


def _user(said: Column) -> Column:
    """User information without an empty password, and none where it is empty."""
    return F.regexp_replace(said, r"^:?@\z|:(?=@\z)", "")


def canonical(url: Column, drop_www: bool = True) -> Column:
    """Without www (if asked), default port, dot segments, tracking keys, fragment and one last slash; null unless http(s).

    A query that loses a key is written anew, each pair form-encoded; another one stays as it is.
    """
    names = ("scheme", "host", "port", "path", "query")

    def parts(u: Column) -> Column:
        return let(F.struct(*[F.regexp_extract(u, URL, i).alias(n) for i, n in enumerate(names, 1)], F.regexp_extract(u, USER, 1).alias("user")), build)

    def plain(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    def pair(p: Column) -> Column:
        return F.concat(F.url_encode(plain(F.regexp_extract(p, "^[^=]*", 0))), F.lit("="), F.url_encode(plain(F.regexp_extract(p, "^[^=]*=(.*)$", 1))))

    def cleaned(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda p: ~F.lower(plain(F.get(F.split(p, "="), F.lit(0)))).isin(*TRACKING))
        return F.when(F.size(kept) == F.size(pairs), F.array_join(pairs, "&")).otherwise(F.array_join(F.transform(F.filter(kept, lambda p: p != ""), pair), "&"))

    def build(x: Column) -> Column:
        scheme, name = F.lower(x["scheme"]), F.lower(x["host"])
        if drop_www:
            name = F.regexp_replace(name, r"^www\.", "")
        default = F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
        shown = F.when((x["port"] == "") | (x["port"] == default), F.lit("")).otherwise(F.concat(F.lit(":"), x["port"]))
        query = let(cleaned(F.split(F.substring(x["query"], 2, 1 << 30), "&")), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
        whole = F.concat(scheme, F.lit("://"), _user(x["user"]), name, shown, _resolved(x["path"]), query)
        return F.when(x["scheme"] != "", F.regexp_replace(whole, r"/\z", ""))

    return let(standard(url), parts)


def direct_urls(question: Column, most: int = 3) -> Column:
    """Links in a question, cleaned of closing punctuation and canonical, each once, in order."""
    found = F.regexp_extract_all(question, F.lit(f"(?i)(https?://{NOT_WS}+)"), F.lit(1))
    clean = F.transform(found, lambda u: canonical(F.regexp_replace(trim(u), r"[),.;!?\]]+\z", ""), drop_www=False))
    return F.slice(F.array_distinct(F.filter(clean, lambda u: u.isNotNull())), 1, most)


def profile(url: Column) -> Column:
    """(kind, source_kind, prefers_rendering) of a URL; the first rule that fits."""


    def seen(u: Column) -> Column:
        return let(F.struct(host_of(u).alias("h"), F.lower(path_of(u)).alias("p")), lambda x: _profile(x["h"], x["p"]))

    return let(standard(url), seen)


def place(url: Column) -> Column:
    """Struct (profile, host) of one reading of a URL: profile() and host_or_url()."""

    def seen(u: Column) -> Column:
        return let(F.struct(host_of(u).alias("h"), F.lower(path_of(u)).alias("p")), lambda x: F.struct(_profile(x["h"], x["p"]).alias("profile"), F.coalesce(x["h"], F.lower(url)).alias("host")))

    return let(standard(url), seen)


def _profile(h: Column, p: Column) -> Column:
    def at(name: str, start: str = "") -> Column:
        return (h == name) & F.startswith(p, F.lit(start))

    def has(*parts: str) -> Column:
        out = F.contains(p, F.lit(parts[0]))
        for x in parts[1:]:
            out = out | F.contains(p, F.lit(x))
        return out

    rules = [
        (at("playwright.dev", "/docs/api/") | at("vitest.dev", "/config/"), "official-api", "official-api", False),
        (at("playwright.dev", "/docs/") | at("vitest.dev", "/guide/") | (at("github.com", "/vitest-dev/vitest/") & has("/docs/")) | at("learn.microsoft.com"), "official-docs", "official-docs", False),
        (at("github.com") & has("/issues/", "/discussions/"), "issue-thread", "issue-thread", True),
        ((at("reddit.com") & has("/comments/")) | at("stackoverflow.com", "/questions/") | (F.concat(h, F.lit(".")).rlike(rf"(^|\.)({FORUM_LABELS})\.") & has(*FORUM_PATHS)), "forum-thread", "community", True),
        (at("npmjs.com", "/package/"), "package-page", "package-page", False),
    ]
    out = None
    for test, kind, source, rendering in rules:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source_kind"), F.lit(rendering).alias("prefers_rendering"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit("community").alias("kind"), F.lit("community").alias("source_kind"), F.lit(False).alias("prefers_rendering")))


def source_rank(kind: Column) -> Column:
    order = {"primary-content": -1, "official-docs": 0, "official-api": 1, "official-discussion": 2, "issue-thread": 3, "community": 4, "package-page": 5}
    out = F.lit(6)
    for name, rank in order.items():
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


def candidate_score(url: Column, discussion: Column) -> Column:
    """Order in which search hits are read; lower first. Questions that want a discussion have a scale of their own."""

    def seen(u: Column) -> Column:
        return let(F.struct(host_of(u).alias("h"), F.lower(path_of(u)).alias("p")), lambda x: _score(_profile(x["h"], x["p"])["kind"], x["h"], discussion))

    return let(standard(url), seen)


def candidate_scores(url: Column) -> Column:
    """Struct (plain, talk): candidate_score() on both scales, from one reading of the URL."""

    def both(x: Column) -> Column:
        return F.struct(*[_score(x["k"], x["h"], F.lit(talk)).alias(name) for name, talk in (("plain", False), ("talk", True))])

    def seen(u: Column) -> Column:
        named = let(F.struct(host_of(u).alias("h"), F.lower(path_of(u)).alias("p")), lambda x: F.struct(_profile(x["h"], x["p"])["kind"].alias("k"), x["h"].alias("h")))
        return let(named, both)

    return let(standard(url), seen)


def _score(kind: Column, h: Column, discussion: Column) -> Column:
    repo = F.coalesce((h == "github.com") | F.endswith(h, F.lit(".github.com")), F.lit(False))
    talk = F.when(kind == "forum-thread", 2).when(kind == "issue-thread", 3).when(repo, 4).when(kind == "package-page", 6).otherwise(5)
    plain = F.when(kind == "issue-thread", 2).when(repo, 3).when(kind == "package-page", 5).otherwise(4)
    return F.when(kind == "official-docs", 0).when(kind == "official-api", 1).when(discussion, talk).otherwise(plain)


def settings_url(raw: Column) -> Column:
    """Struct (ok, value, message) of a base URL in a configuration: any http(s) URL, without one last slash."""

    def build(x: Column) -> Column:
        scheme, port = F.lower(_part(x, 1)), _part(x, 3)
        default = F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
        shown = F.when((port == "") | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port))
        whole = F.concat(scheme, F.lit("://"), _user(F.regexp_extract(x, USER, 1)), full_host_of(x), shown, path_of(x), _part(x, 5), _part(x, 6))
        ok = F.coalesce(x.rlike(URL), F.lit(False))
        return F.struct(ok.alias("ok"), F.when(ok, F.regexp_replace(whole, r"/\z", "")).alias("value"), F.when(~ok, "Invalid URL. Include http:// or https://.").alias("message"))

    return let(standard(trim(raw)), build)


def search_url(query: Column) -> Column:
    return F.concat(F.lit("https://html.duckduckgo.com/html/?q="), F.url_encode(query))


def unwrap_redirect(raw: Column) -> Column:
    """Target of a search engine's redirect link; the raw link where it is none or can't be decoded."""
    absolute = F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).otherwise(raw)
    return let(standard(absolute), lambda u: F.coalesce(F.when((full_host_of(u) == "duckduckgo.com") & (path_of(u) == "/l/"), value_of(u, "uddg")), raw))
