"""Evidence: what a read page contributes, ranking, quality and the next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foragelake.functions.text import collapse, conflict_flags, cut, is_bot_check, summary
from foragelake.functions.urls import host_or_url, place, profile, source_rank

READERS = ("github", "pdf", "youtube")
PASSES, RENDERS, DIRECT = 3, 2, 3
SUMMARY, SUPPORT = 180, 120
COUNTS = ("total", "official", "community", "thread", "primary_content", "strong", "docs", "api", "distinct_hosts")
# Caveats in the order in which they are told, and the messages that stand for them.
REASONS = {
    "community-only": "the strongest readable sources were mostly community/practical context",
    "low-diversity": "the source set was narrow",
    "unreadable-direct-source": "one or more linked sources could not be read reliably",
    "unreadable-thread-source": "one or more thread sources could not be read reliably",
    "possible-conflict": "readable sources include cautionary or possibly conflicting guidance",
    "bot-check": "some candidate sources showed bot-check or security verification pages",
}
GENERIC_CAVEAT = "Evidence is partial, so this answer is based on the strongest source found within the bounded research budget."
DIRECT_UNREADABLE, THREAD_UNREADABLE = "Direct URL could not be read reliably", "Thread source could not be read reliably"
LOW_VALUE = {"bot-check": "Fetched page showed a bot-check or security verification page.", "low-value-page": "Fetched page did not add strong research evidence."}
COMMUNITY_PREFIX = "Community/practical context: "


def page_facts(fetches: DataFrame) -> DataFrame:
    """What each fetched page is worth, whatever question reads it.

    page (its URL), final_url, status, method, page_title, f_message; source_kind as evidence, host, caution, praise, forum,
    prefers_rendering; found and linked: whether it is evidence for a search and for a question that links it; low_value;
    said and primary: its words. A reader's text is primary content in full; other pages give a summary. Package pages give
    no evidence in a search; as a link of the question they may, and blank text never does there.
    """
    c, final = F.col, F.coalesce("final_url", "url")
    rows = fetches.select(
        c("url").alias("page"), final.alias("final_url"), "status", "method", c("title").alias("page_title"), c("message").alias("f_message"), "text",
        place(final).alias("at"), summary(c("text"), SUMMARY).alias("short"), is_bot_check(c("title"), c("text")).alias("bot"),
    )
    rows = rows.select("*", "at.host", c("at.profile").alias("p")).drop("at")
    kept = ("page", "final_url", "status", "method", "page_title", "f_message", "host")
    ok, blank = (c("status") == "ok") & c("text").isNotNull(), c("short") == ""
    primary = c("method").isin(*READERS) & ~blank
    found = ok & ~c("bot") & (primary | (c("p.source_kind") != "package-page"))
    rows = rows.select(
        *kept, primary.alias("primary"), found.alias("found"), (ok & ~c("bot") & ~blank).alias("linked"),
        F.when(ok & c("bot"), F.lit("bot-check")).when(ok & ~found, F.lit("low-value-page")).alias("low_value"),
        F.when(primary, F.lit("primary-content")).otherwise(c("p.source_kind")).alias("source_kind"),
        (c("p.kind") == "forum-thread").alias("forum"), "p.prefers_rendering", F.when(primary, c("text")).otherwise(c("short")).alias("said"),
    )
    caution, praise = conflict_signs(c("said"), c("primary"))
    used = c("found") | c("linked")
    return rows.withColumns({"caution": F.when(used, caution), "praise": F.when(used, praise)})


def support(said: Column, primary: Column) -> Column:
    return F.when(primary, said).otherwise(cut(said, SUPPORT))


def conflict_signs(said: Column, primary: Column) -> tuple[Column, Column]:
    """conflict_flags() of a page's summary and support; those of primary content are the same text."""
    return conflict_flags(F.when(primary, said).otherwise(F.concat_ws("\n", said, support(said, primary))))


def best_evidence(evidence: DataFrame, *keys: str) -> DataFrame:
    """Each URL's best row by source rank (ties: the earlier): keys, url, first (the URL's first place), r (the other columns)."""
    rows = evidence.filter("source_kind <> 'package-page'").withColumn("source_rank", source_rank(F.col("source_kind")))
    row = F.struct(*[x for x in rows.columns if x not in (*keys, "url", "ordinal")])
    return rows.groupBy(*keys, "url").agg(F.min_by(row, F.struct("source_rank", "ordinal")).alias("r"), F.min("ordinal").alias("first"))


def ranked_evidence(best: DataFrame, *keys: str) -> DataFrame:
    """Rows of best_evidence() in the order of rank and first place: + pos."""
    order = Window.partitionBy(*keys).orderBy("r.source_rank", "first")
    return best.withColumn("pos", F.row_number().over(order) - 1).select(*keys, "pos", "url", "r.*").drop("source_rank")


def rank_evidence(evidence: DataFrame, *keys: str) -> DataFrame:
    """Each URL's best row by source rank (ties: the earlier), ordered by rank and the URL's first place: + pos."""
    return ranked_evidence(best_evidence(evidence, *keys), *keys)


def unreadable_flags(message: Column) -> dict[str, Column]:
    """Whether a gap's message tells of a link or of a thread that could not be read."""
    return {"direct": message.rlike(f"(?i){DIRECT_UNREADABLE}"), "threads": message.rlike(f"(?i){THREAD_UNREADABLE}")}


def evidence_facts(ranked: DataFrame, *keys: str) -> DataFrame:
    """Counts and flags of the evidence (source_kind, host, caution, praise) of each group."""
    k = F.col("source_kind")
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(k.isin("official-docs", "official-api")).alias("official"),
        F.count_if(k == "community").alias("community"),
        F.count_if(k.isin("issue-thread", "official-discussion")).alias("thread"),
        F.count_if(k == "primary-content").alias("primary_content"),
        F.count_if(k.isin("official-docs", "official-api", "official-discussion")).alias("strong"),
        F.count_if(k == "official-docs").alias("docs"),
        F.count_if(k == "official-api").alias("api"),
        # A group has few hosts; a distinct count would shuffle the rows once more.
        F.size(F.collect_set("host")).cast("long").alias("distinct_hosts"),
        (F.bool_or("caution") & F.bool_or("praise")).alias("conflict"),
    )


def judged(facts: DataFrame) -> DataFrame:
    """Groups with what evidence_facts() has (null: no evidence) and the flags direct, threads and bot (null: false) -> + only_community,
    low_diversity and ordered caveat reasons."""
    out = facts.fillna(0, list(COUNTS)).fillna(False, ["conflict", "direct", "threads", "bot"])
    only = (F.col("total") > 0) & (F.col("official") == 0) & (F.col("primary_content") == 0)
    narrow = (F.col("total") > 1) & (F.col("distinct_hosts") <= 1) & (F.col("primary_content") == 0)
    tests = dict(zip(REASONS, (only, narrow, F.col("direct"), F.col("threads"), F.col("conflict"), F.col("bot")), strict=True))
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]))
    return out.withColumn("only_community", only).withColumn("low_diversity", narrow).withColumn("reasons", reasons)


def quality(ranked: DataFrame, gaps: DataFrame, low_values: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Counts, flags and ordered caveat reasons for each row of groups (keys)."""
    caution, praise = conflict_flags(F.concat_ws("\n", "summary", "support"))
    facts = evidence_facts(ranked.withColumns({"host": host_or_url(F.col("url")), "caution": caution, "praise": praise}), *keys)
    unread = gaps.groupBy(*keys).agg(*[F.bool_or(f).alias(n) for n, f in unreadable_flags(F.col("message")).items()])
    bots = low_values.groupBy(*keys).agg(F.bool_or(F.col("kind") == "bot-check").alias("bot"))
    on = list(keys)
    return judged(groups.select(*keys).join(facts, on, "left").join(unread, on, "left").join(bots, on, "left"))


def next_step(pass_index: Column, suggested: Column, attempts: Column, strong: Column | None = None) -> Column:
    """answer, answer-with-caveat, search-again or headless, from a row of quality()."""
    strong = F.col("strong") if strong is None else strong
    both = (F.col("docs") > 0) & (F.col("api") > 0)
    enough = (strong >= 2) & (F.col("official") > 0)
    budget = pass_index + 1 < PASSES
    better = budget & (F.col("only_community") | (F.col("low_diversity") & ~both))
    concerns = F.when(both, F.array_remove("reasons", "low-diversity")).otherwise(F.col("reasons"))
    return (
        F.when(enough & better, "search-again")
        .when(enough & (F.size(concerns) > 0), "answer-with-caveat")
        .when(enough, "answer")
        .when(suggested.isNotNull() & (attempts < RENDERS), "headless")
        .when(budget, "search-again")
        .otherwise("answer-with-caveat")
    )


def caveat_text(partial: Column, reasons: Column) -> Column:
    sentences = F.transform(reasons, _sentence)
    n = F.size(sentences)
    listed = F.when(n == 1, F.get(sentences, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(sentences, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(sentences, F.when(n > 0, -1).otherwise(1))))
    return F.when(partial & (n > 0), F.concat(F.lit("Evidence is partial: "), listed, F.lit("."))).when(partial, F.lit(GENERIC_CAVEAT))


def _sentence(reason: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in REASONS.items():
        out = F.when(reason == name, F.lit(text)).otherwise(out)
    return out


def finding(kind: Column, text: Column) -> Column:
    return finding_of(kind, collapse(text))


def finding_of(kind: Column, bare: Column) -> Column:
    """The same of a collapsed text."""
    return F.concat(F.when(kind.isin("community", "issue-thread"), F.lit(COMMUNITY_PREFIX)).otherwise(F.lit("")), bare)


def unreadable_message(url: Column, forum: Column | None = None) -> Column:
    forum = profile(url)["kind"] == "forum-thread" if forum is None else forum
    start = F.when(forum, F.lit(THREAD_UNREADABLE)).otherwise(F.lit(DIRECT_UNREADABLE))
    return F.concat(start, F.lit(": "), url)
