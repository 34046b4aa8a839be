"""Reading text from HTML, and telling pages that can't be read. Pages are read in small batches, in time that follows their
length; all other functions are Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from foragelake.functions.readable import article, nested_style
from foragelake.functions.tags import parse
from foragelake.functions.text import collapse, cut, let, summary

PAGE_CAP, READER_CAP = 4000, 24_000
# Fixed values.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"'}
DROPPED = ("script", "style", "noscript", "svg", "template")
JS_REQUIRED = "enable javascript|javascript required|please turn on javascript"
SHELL_ROOTS = ('id="app"', 'id="root"')
TOKENS = r"(?i)(&(?:#\d+|#x[\da-f]+|nbsp|amp|lt|gt|quot);|[^&]+|&)"


def _character(code: Column) -> Column:
    """The UTF-16 unit of a number; a lone surrogate becomes the replacement character."""
    safe = let(code % 65536, lambda unit: F.when(unit.between(55296, 57343), F.lit(65533)).otherwise(unit))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 4, "0")), "UTF-16BE")


def _decode_one(token: Column) -> Column:
    return let(token, _decoded)


def _decoded(token: Column) -> Column:
    low = F.lower(token)
    out = token
    for name, text in ENTITIES.items():
        out = F.when(low == name, F.lit(text)).otherwise(out)
    decimal = F.regexp_extract(low, r"^&#(\d+);$", 1).try_cast("long")
    hexadecimal = F.conv(F.nullif(F.regexp_extract(low, r"^&#x([\da-f]+);$", 1), F.lit("")), 16, 10).try_cast("long")
    return F.coalesce(_character(F.coalesce(decimal, hexadecimal)), out)


def decode_entities(c: Column) -> Column:
    """One pass over the entities, so that nothing is decoded twice."""


    def decode(x: Column) -> Column:
        tokens = F.regexp_extract_all(x, F.lit(TOKENS), F.lit(1))
        return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(tokens, _decode_one), "")).otherwise(x)

    return let(c, decode)


def _decode(m: re.Match) -> str:
    if m[1] or m[2]:
        number = float(int(m[1] or m[2], 10 if m[1] else 16)) if len(m[0]) < 300 else float("inf")
        unit = 0 if number == float("inf") else int(number) % 65536
        return chr(65533 if 55296 <= unit <= 57343 else unit)
    return ENTITIES[m[0].lower()]


def _between(page: str, tag: str, at: int = 0) -> tuple[int, int, int, int] | None:
    """Start and end of the first opening tag that has an end tag after it, and of that end tag.

    Beyond the last > no tag ends, and where the first opening tag has no end after it no later one has; so no text is
    searched twice.
    """
    begin, end = _PAIRS[tag]
    first = begin.search(page, at, page.rfind(">") + 1)
    last = end.search(page, first.end()) if first else None
    return (first.start(), first.end(), last.start(), last.end()) if last else None


def _untagged(page: str) -> str:
    stop = page.rfind(">") + 1
    return _TAG.sub(" ", page[:stop]) + page[stop:]


def _squeezed(said: str) -> str:
    # Splitting is much faster; it differs from white space here in these characters only.
    if any(x in said for x in _SPLIT_ELSE):
        return _SPACES.sub(" ", said).strip(" ")
    return " ".join(said.split())


def _may_have(low: str, tag: str) -> bool:
    """Whether a page can have an element, from its lower-case form; searching for patterns in any case is slow."""
    return f"<{tag}" in low and f"</{tag}>" in low


def plain_title(page: str, low: str | None = None) -> str | None:
    found = _between(page, "title") if _may_have(page.lower() if low is None else low, "title") else None
    return _ENTITY.sub(_decode, _squeezed(_untagged(page[found[1] : found[2]]))) or None if found else None


def plain_text(page: str, low: str | None = None) -> str:
    """Text inside of the first main, article or body element, else of everything."""
    low = page.lower() if low is None else low
    for tag in ("main", "article", "body"):
        if _may_have(low, tag) and (found := _between(page, tag)):
            page = page[found[1] : found[2]]
            break
    for tag in DROPPED:
        if not _may_have(low, tag):
            continue
        out, at = [], 0
        while found := _between(page, tag, at):
            out += [page[at : found[0]], " "]
            at = found[3]
        page = "".join([*out, page[at:]])
    return _squeezed(_untagged(_ENTITY.sub(_decode, page)))


_PAIRS = {t: (re.compile(rf"<{t}\b[^>]*>", re.I | re.A), re.compile(f"</{t}>", re.I | re.A)) for t in ("main", "article", "body", *DROPPED)}
_PAIRS["title"] = (re.compile("<title[^>]*>", re.I | re.A), re.compile("</title>", re.I | re.A))
_TAG = re.compile("<[^>]+>")
_ENTITY = re.compile(r"&(?:#([0-9]+)|#x([0-9a-f]+)|nbsp|amp|lt|gt|quot);", re.I | re.A)
_SPACE = "\t\n\x0b\x0c\r \xa0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{_SPACE}]+")
#: What str.split() takes for white space and browsers don't, and the other way round.
_SPLIT_ELSE = "\x1c\x1d\x1e\x1f\x85\ufeff"
_PLAIN = StructType([StructField("title", StringType()), StructField("text", StringType())])
_FETCHED = StructType([*_PLAIN.fields, StructField("shell", BooleanType())])
_READ = StructType([*[StructField(n, StringType()) for n in ("title", "byline", "text", "mode")]])


# Pages are long, and an Arrow batch holds 10,000 of them; plain functions get a hundred at a time.


@F.udf(_PLAIN, useArrow=False)
def _plain(page: str | None) -> tuple[str | None, str | None]:
    if page is None:
        return None, None
    low = page.lower()
    return plain_title(page, low), plain_text(page, low)


@F.udf(_FETCHED, useArrow=False)
def _fetched(page: str | None) -> tuple[str | None, str | None, bool | None]:
    if page is None:
        return None, None, None
    low = page.lower()
    return plain_title(page, low), plain_text(page, low)[:PAGE_CAP], "<script" in low and any(x in low for x in SHELL_ROOTS)


def read_page(page: str) -> tuple[str | None, str | None, str, str]:
    tree = parse(page)
    if nested_style(tree):
        return plain_title(page), None, plain_text(page), "fallback"
    title, byline, text = article(tree)
    return title or None, byline, text, "readability"


@F.udf(_READ, useArrow=False)
def _read(page: str | None) -> tuple[str | None, ...]:
    return (None,) * 4 if page is None else read_page(page)


def readable(html: Column, most: int = PAGE_CAP) -> Column:
    """Struct (title, byline, text, mode): the article of a page, at most `most` characters of it. Pages whose style sheets
    strict parsers reject are read the plain way, with mode 'fallback'. Null stays null."""
    return F.transform(F.array(_read(html)), lambda r: F.struct(r["title"].alias("title"), r["byline"].alias("byline"), cut(r["text"], most).alias("text"), r["mode"].alias("mode")))[0]


def plain(html: Column) -> Column:
    """Struct (title, text) of one reading, the text whole."""
    return _plain(html)


def fetched(html: Column) -> Column:
    """Struct (title, text, shell) of one reading: the text up to PAGE_CAP, and is_script_shell()."""
    return _fetched(html)


def title(html: Column) -> Column:
    return plain(html)["title"]


def text(html: Column, most: int = PAGE_CAP) -> Column:
    return cut(plain(html)["text"], most)


def clean_rendered(c: Column) -> Column:
    """Repeated buttons of rendered pages once."""
    for phrase in ("Show more", "Privacy Terms"):
        c = F.regexp_replace(c, rf"(?i)({phrase})(\s+\1)+", "$1")
    return collapse(c)


def is_script_shell(html: Column) -> Column:
    low = F.lower(html)
    return F.contains(low, F.lit("<script")) & (F.contains(low, F.lit(SHELL_ROOTS[0])) | F.contains(low, F.lit(SHELL_ROOTS[1])))


def is_weak(html: Column, body: Column, bare: bool = False) -> Column:
    """A short text of a page that is much longer or asks for scripts. Only pages with a short text are looked at whole.
    bare: the text is collapsed, but for a blank at its end where it was cut."""

    def weak(x: Column) -> Column:
        n, page = x["n"], x["page"]
        short = (n > 0) & (n < 120)
        sparse = let(F.length(collapse(page)), lambda whole: (whole > 0) & (n / whole < 0.02))
        return short & F.when(short, sparse | page.rlike(f"(?i){JS_REQUIRED}"))

    # Only whether there are 120 characters counts, and most texts begin with them.
    return let(F.struct(F.length(F.trim(body) if bare else summary(body, 120)).alias("n"), html.alias("page")), weak)


def fetch_status(content_type: Column, html: Column, body: Column, shell: Column | None = None) -> Column:
    """ok, needs_headless, or unsupported for what isn't HTML. shell: that of fetched(), where body is its text."""
    weak = (is_script_shell(html) if shell is None else shell) | (F.length(body) < 40) | is_weak(html, body, bare=shell is not None)
    return F.when(~F.contains(F.coalesce(content_type, F.lit("")), F.lit("text/html")), F.lit("unsupported")).when(weak, F.lit("needs_headless")).otherwise(F.lit("ok"))
