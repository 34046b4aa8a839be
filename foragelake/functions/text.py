"""Text functions with the white space and word rules of web scripts, as Column expressions.

White space is the Unicode set that browsers trim, wider than Spark's `trim`; words are ASCII, narrower than Java's `\\b`.
Lengths and cuts count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{0b}\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
#: White space but the plain blank.
ODD_WS = WS.replace(r"\s", r"\t\n\f\r", 1)
#: One cheap look that most letters don't pass, before the many ranges of white space are tried.
MAYBE_WS = r"(?=[^\x21-\x7e\x{a1}-\x{167f}\x{3001}-\x{fefe}])"

# Fixed values.
STOP_WORDS = ("find", "current", "tell", "me", "how", "to", "the", "and", "with", "for", "in", "a", "an")
DISCUSSION = "reddit|forum|forums|discussion|thread|comments|community|user experience|people recommend"
BOT_CHECK = "performing security verification|security service|verify you are not a bot|just a moment|checking your browser"
SHELL_COMMAND = r"(?i)(?<![A-Za-z0-9_])(Invoke-WebRequest|Invoke-RestMethod|curl(?:\.exe)?|wget|npm\s+(?:view|search|pack)|pip\s+index)(?![A-Za-z0-9_])|https?://"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often `use` mentions it; keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    # A single blank stays as it is, so that most of a text needs no replacement.
    return F.trim(F.regexp_replace(c, f"{MAYBE_WS}(?:{WS}{{2,}}|{ODD_WS})", " "))


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def summary(c: Column, n: int = 180) -> Column:
    """The first n characters of a collapsed text. What its beginning collapses to is how the whole begins, so the rest is
    only looked at where the beginning is mostly white space."""

    def begin(x: Column) -> Column:
        return cut(F.when((F.length(x["b"]) >= n) | (F.length(x["c"]) <= 2 * n), x["b"]).otherwise(collapse(x["c"])), n)

    # The text goes in with its beginning: it may be a Python function's, which Spark allows in no lambda's body.
    return let(F.struct(c.alias("c"), collapse(cut(c, 2 * n)).alias("b")), begin)


def word_count(c: Column) -> Column:
    """Number of words; null where there is none."""
    return let(collapse(c), words_of)


def words_of(bare: Column) -> Column:
    """The same of a collapsed text."""
    return F.when(bare != "", (F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long"))


def excerpt(c: Column, n: int = 240) -> Column:
    def short(x: Column) -> Column:
        return F.concat(F.regexp_replace(cut(x, n), rf"{WS}+\z", ""), F.lit("…"))

    return let(c, lambda x: F.when(x == "", None).when(F.length(x) <= n, x).otherwise(short(x)))


def important_words(query: Column) -> Column:
    return words_left(collapse(query))


def words_left(bare: Column) -> Column:
    """Of a collapsed text, all but the stop words."""
    begin = "".join(sorted({w[0] for w in STOP_WORDS}))
    words = rf"(?i)(?=[{begin}])(?<![A-Za-z0-9_])({'|'.join(STOP_WORDS)})(?![A-Za-z0-9_])"
    return collapse(F.regexp_replace(bare, words, " "))


def official_query(bare: Column, terms: Column) -> Column:
    low = F.lower(bare)
    out = F.concat(terms, F.lit(" official docs"))
    for mark, site in (("edge", "learn.microsoft.com"), ("playwright", "playwright.dev"), ("vitest", "vitest.dev")):
        out = F.when(F.contains(low, F.lit(mark)), F.concat(F.lit(f"site:{site} "), terms)).otherwise(out)
    return out


def planned_queries(bare: Column, terms: Column) -> Column:
    """What a question asks, in order: itself, collapsed, then up to three rewrites of its important words that differ from it."""
    # Both are collapsed already, so a rewrite can only have a blank at an end.
    later = F.array(*[F.trim(q) for q in (official_query(bare, terms), F.concat(F.lit("site:github.com "), terms), F.concat(terms, F.lit(" discussion")))])
    return F.concat(F.filter(F.array(bare), lambda q: q != ""), F.filter(later, lambda q: (q != "") & (q != bare)))


def wants_discussion(query: Column) -> Column:
    return query.rlike(f"(?i){DISCUSSION}")


def is_bot_check(title: Column, text: Column) -> Column:
    return _told(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), text), BOT_CHECK.split("|"), lambda c: c.rlike(f"(?i){BOT_CHECK}"))


def _told(said: Column, words: list[str] | tuple[str, ...], test: Callable[[Column], Column]) -> Column:
    """test(said), a slow pattern that only texts with one of these words in any case can meet."""

    def some(low: Column) -> Column:
        found = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(low, F.lit(w))
        return found

    return let(F.lower(said), some) & test(said)


def conflict_flags(said: Column) -> tuple[Column, Column]:
    """Whether a text has cautionary words, and whether it has recommending ones that aren't part of a caution."""
    edge = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    warned = f"{edge[0]}deprecated{edge[1]}|not recommended|use at your own risk|should not"
    caution = _told(said, ("deprecated", "not recommended", "use at your own risk", "should not"), lambda c: F.lower(c).rlike(warned))
    return caution, _told(said, ("recommended",), lambda c: F.regexp_replace(F.lower(c), "not recommended", "").rlike(f"{edge[0]}recommended{edge[1]}"))


def has_conflict(said: Column) -> Column:
    """Cautionary and recommending words in one body of text."""
    caution, praise = conflict_flags(said)
    return caution & praise


def version_parts(v: Column) -> Column:
    """Three numbers; missing and unreadable ones are 0."""
    parts = F.split(v, r"\.")
    return F.array(*[F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3)])
