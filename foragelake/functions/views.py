"""Compact, preview and verbose texts of searches, page reads and answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foragelake.functions.text import excerpt, trim, word_count

# What a reading method is called.
LABELS = {"headless": "web_fetch_headless", "firecrawl": "firecrawl", "http": "web_fetch", "github": "github", "pdf": "pdf", "youtube": "youtube"}


def _lines(*parts: Column, sep: str = "\n") -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), sep)


def _numbered(hits: Column, most: int, show) -> Column:
    text = F.array_join(F.transform(F.slice(hits, 1, most), lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), show(h))), "\n")
    return F.nullif(text, F.lit(""))


def fanout_note(providers: Column, skipped: Column) -> Column:
    """providers and skipped are comma-separated names, or null."""
    used, missed = F.replace(F.nullif(providers, F.lit("")), F.lit(","), F.lit(", ")), F.replace(F.nullif(skipped, F.lit("")), F.lit(","), F.lit(", "))
    tail = F.coalesce(F.concat(F.lit("; skipped: "), missed), F.lit(""))
    return F.when(used.isNotNull(), F.concat(F.lit(" (fanout: "), used, tail, F.lit(")"))).when(missed.isNotNull(), F.concat(F.lit(" (fanout; skipped: "), missed, F.lit(")"))).otherwise(F.lit(""))


def fallback_prefix(failed: Column, used: Column) -> Column:
    return F.coalesce(F.concat(failed, F.lit(" failed; used "), used, F.lit(" fallback. ")), F.lit(""))


def search_compact(status: Column, n: Column, message: Column, prefix: Column, note: Column) -> Column:
    bad = F.concat(prefix, F.lit("Search failed: "), F.coalesce(message, F.lit("Unknown search failure.")), note)
    good = F.concat(prefix, F.lit("Found "), n.cast("string"), F.when(n == 1, " result").otherwise(" results"), note)
    return F.when(status == "error", bad).otherwise(good)


def search_preview(hits: Column) -> Column:
    return _numbered(hits, 3, lambda h: h["title"])


def search_verbose(hits: Column) -> Column:
    return _numbered(hits, 5, lambda h: F.concat(h["title"], F.lit("\n   "), h["url"], F.lit("\n   "), h["snippet"]))


def fetch_compact(status: Column, text: Column, message: Column, prefix: Column) -> Column:
    words = F.coalesce(F.concat(F.lit(" · "), word_count(text).cast("string"), F.lit(" words")), F.lit(""))
    return (
        F.when(status == "ok", F.concat(prefix, F.lit("Fetched page · article extracted"), words))
        .when(status == "needs_headless", F.concat(prefix, F.lit("Needs headless rendering: "), F.coalesce(message, F.lit("Headless rendering recommended."))))
        .otherwise(F.concat(prefix, F.lit("Fetch failed: "), F.coalesce(message, F.lit("Unknown fetch failure."))))
    )


def fetch_preview(title: Column, text: Column) -> Column:
    named = trim(F.concat(title, F.lit("\n"), F.coalesce(excerpt(text), F.lit(""))))
    return F.when(F.nullif(title, F.lit("")).isNotNull(), named).otherwise(excerpt(text))


def fetch_verbose(status: Column, url: Column, title: Column, text: Column) -> Column:
    return F.when(status == "ok", _lines(F.concat(F.lit("URL: "), url), F.concat(F.lit("Title: "), F.nullif(title, F.lit(""))), excerpt(text, 500)))


def label(method: Column) -> Column:
    out = F.lit("web_explore")
    for name, shown in LABELS.items():
        out = F.when(method == name, F.lit(shown)).otherwise(out)
    return out


def internal_summary(passes: Column, pages: Column, renders: Column, note: Column) -> Column:
    return F.concat(F.lit("Internal research: web_search ×"), passes.cast("string"), note, F.lit(", web_fetch ×"), pages.cast("string"), F.lit(", web_fetch_headless ×"), renders.cast("string"))


def _evidence_lines(findings: Column, sources: Column) -> Column:
    def line(f: Column, i: Column) -> Column:
        return F.concat(F.lit("- ["), label(F.get(sources, i)["method"]), F.lit("] "), f)

    some = (F.size(findings) > 0) | (F.size(sources) > 0)
    return F.when(some, F.transform(findings, line)).otherwise(F.array(F.lit("No usable evidence found.")))


def explore_compact(findings: Column, sources: Column) -> Column:
    some = (F.size(findings) > 0) | (F.size(sources) > 0)
    return F.when(some, F.concat(F.lit("Reviewed "), F.size(sources).cast("string"), F.lit(" sources · synthesized answer with "), F.size(findings).cast("string"), F.lit(" findings"))).otherwise(F.lit("No usable evidence found"))


def explore_preview(findings: Column, sources: Column, internal: Column) -> Column:
    return F.array_join(F.concat(_evidence_lines(findings, sources), F.array(F.concat(F.lit("\n"), internal))), "\n")


def explore_verbose(findings: Column, sources: Column, internal: Column, caveat: Column) -> Column:
    listed = F.transform(sources, lambda s: F.concat(F.lit("- ["), label(s["method"]), F.lit("] "), s["title"], F.lit(": "), s["url"]))
    tail = F.array_compact(F.array(F.concat(F.lit("\nInternal tools\n"), internal), F.concat(F.lit("\nCaveat\n"), caveat)))
    return F.array_join(F.concat(F.array(F.lit("Findings")), _evidence_lines(findings, sources), F.array(F.lit(""), F.lit("Sources")), listed, tail), "\n")


def select_view(mode: Column, compact: Column, preview: Column, verbose: Column) -> Column:
    """The view asked for, where there is one, else the compact one."""
    return F.coalesce(F.when(mode == "preview", F.nullif(preview, F.lit(""))).when(mode == "verbose", F.nullif(verbose, F.lit(""))), compact)


def model_text(findings: Column, sources: Column, caveat: Column) -> Column:
    """Findings, sources and caveat as one text."""
    listed = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("- "), s["title"], F.lit(": "), s["url"])), "\n")
    parts = F.array(F.array_join(findings, "\n\n"), F.when(F.size(sources) > 0, F.concat(F.lit("Sources:\n"), listed)), caveat)
    text = F.array_join(F.filter(F.array_compact(parts), lambda p: p != ""), "\n\n")
    return F.when((F.size(findings) == 0) & (F.size(sources) == 0), F.lit("No usable evidence found.")).otherwise(text)
