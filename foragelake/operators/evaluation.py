"""Evaluation of research runs: texts of message documents, failure cases, time stamps and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foragelake.functions.text import let, trim
from foragelake.operators.config import text

#: The parser takes no deeper documents.
DEEPEST = 1000


def iso_text(ts: Column) -> Column:
    """A UTC time as text with milliseconds; the session's time zone has no say."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def file_stamp(iso: Column) -> Column:
    return F.translate(iso, ":.", "--")


def _lines(items: Column) -> Column:
    return F.array_join(F.filter(items, lambda x: x != ""), "\n")


def message_text(json: Column) -> Column:
    """All text of a message document, lines joined; empty where there is none, or the document is null or no JSON.

    A string is its own text, a list that of its items (lists in lists at any depth), an object its `text`, else its
    `content`, else the `text` of each item in the list `content`, else all that of an object `message` with such a list.
    """
    opened = F.length(json) - F.length(F.replace(json, F.lit("["), F.lit("")))

    def said(v: Column) -> Column:
        levels = F.sequence(F.lit(1), F.greatest(F.least(opened, F.lit(DEEPEST)), F.lit(1)))
        # A list is read like its items in its place, so each step takes one level of lists out of lists.
        flat = F.aggregate(levels, _list(v, "$"), lambda s, _: F.when(F.exists(s, _is_list), F.flatten(F.transform(s, _items))).otherwise(s))
        return F.when(_is_list(v), _lines(F.transform(flat, lambda x: F.coalesce(_said(x), F.lit(""))))).otherwise(_said(v))

    return F.coalesce(let(F.try_parse_json(json), said), F.lit(""))


def _is_list(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def _items(v: Column) -> Column:
    return F.when(_is_list(v), _list(v, "$")).otherwise(F.array(v))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _said(v: Column) -> Column:
    inner = F.transform(_list(v, "$.content"), lambda x: F.coalesce(text(x, "text"), F.lit("")))
    nested = F.try_variant_get(v, "$.message", "variant")
    # A message whose list `content` stands beside a text of its own gives that text.
    below = F.coalesce(text(nested, "text"), _lines(F.transform(_list(nested, "$.content"), lambda x: F.coalesce(text(x, "text"), F.lit("")))))
    has_list = F.try_variant_get(nested, "$.content", "array<variant>").isNotNull()
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    own_list = F.when(F.try_variant_get(v, "$.content", "array<variant>").isNotNull(), _lines(inner))
    return F.coalesce(plain, text(v, "text"), text(v, "content"), own_list, F.when(has_list, below), F.lit(""))


def judge_failures(cases: DataFrame) -> DataFrame:
    """(title, expected_code, actual_code, expected_message, actual_message, ...) -> + verdict, notes (array); nulls are compared too."""
    c = F.col
    notes = F.array_compact(F.array(
        F.when(~c("expected_code").eqNullSafe(c("actual_code")), F.format_string("expected code %s but got %s", "expected_code", "actual_code")),
        F.when(~c("expected_message").eqNullSafe(c("actual_message")), F.format_string('expected message "%s" but got "%s"', "expected_message", "actual_message")),
    ))
    return cases.withColumn("notes", notes).withColumn("verdict", F.when(F.size("notes") == 0, "pass").otherwise("fail"))


def _bullets(notes: Column) -> Column:
    return F.when(F.size(notes) > 0, F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n")).otherwise("- none")


def failure_section() -> Column:
    """Markdown of one row of judge_failures()."""
    c = F.col
    return F.concat(
        F.lit("### "), c("title"), F.lit("\n\nVerdict: **"), c("verdict"), F.lit("**\n\n- expected code: "), c("expected_code"), F.lit("\n- actual code: "), c("actual_code"),
        F.lit("\n- expected message: "), c("expected_message"), F.lit("\n- actual message: "), c("actual_message"), F.lit("\n\nNotes:\n"), _bullets(c("notes")), F.lit("\n"),
    )


def session_section() -> Column:
    """Markdown of a session: title, prompt, verdict, notes (comma-joined), the columns of tool_metrics(), tools (array) and final_answer."""
    c = F.col
    notes = F.filter(F.split(c("notes"), ","), lambda n: n != "")
    tools = F.array_join(F.transform("tools", lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), t)), "\n")
    metrics = (("web_explore used", "explore_used"), ("web_explore first web tool", "explore_first"), ("total tool calls", "tool_calls"), ("total web tool calls", "web_calls"), ("network shell fallbacks after web_explore", "shell_after"))
    lines = [F.concat(F.lit(f"- {label}: "), c(name).cast("string"), F.lit("\n")) for label, name in metrics]
    answer = trim(F.coalesce("final_answer", F.lit("")))
    return F.concat(
        F.lit("## "), c("title"), F.lit("\n\nPrompt: "), c("prompt"), F.lit("\n\nVerdict: **"), c("verdict"), F.lit("**\n\nMetrics:\n"), *lines,
        F.lit("Tool order:\n"), F.when(tools == "", "  none").otherwise(tools), F.lit("\n\nNotes:\n"), _bullets(notes),
        F.lit("\n\nFinal answer:\n\n"), F.when(answer == "", "(empty)").otherwise(answer), F.lit("\n"),
    )


def run_reports(runs: DataFrame, sessions: DataFrame, failures: DataFrame) -> DataFrame:
    """runs (run_id, started, finished, place), sessions (run_id, at, section, verdict), failures (run_id, at, section, verdict)
    -> run_id, stamp (for the file's name), markdown, json (what the run came to, for other programs).

    A run is what one report is about, so its sections are put together in one row; sections of other runs are left out.
    Sections go by `at`, ties by their text. A run without failure cases says so; one without sessions has none.
    """
    c = F.col

    def gathered(df: DataFrame, name: str) -> DataFrame:
        each = F.array_sort(F.collect_list(F.struct("at", "section", "verdict")))
        return df.groupBy("run_id").agg(each.alias(name))

    none = F.array().cast("array<struct<at:bigint,section:string,verdict:string>>")
    rows = runs.join(gathered(sessions, "s"), "run_id", "left").join(gathered(failures, "f"), "run_id", "left")
    rows = rows.withColumn("s", F.coalesce("s", none)).withColumn("f", F.coalesce("f", none))

    def sections(name: str, between: str) -> Column:
        return F.array_join(F.transform(name, lambda x: x["section"]), between)

    def counted(name: str) -> Column:
        verdicts = ("pass", "mixed", "fail")
        return F.struct(F.size(name).alias("cases"), *[F.size(F.filter(name, lambda x: x["verdict"] == v)).alias(v) for v in verdicts])  # noqa: B023

    failed = F.concat(F.lit("## Search failure cases\n\n"), F.when(F.size("f") == 0, "None.\n").otherwise(sections("f", "\n")))
    markdown = F.concat(F.lit("# live web eval\n\nStarted: "), c("started"), F.lit("\nFinished: "), c("finished"), F.lit("\nCWD: "), c("place"), F.lit("\n\n"), sections("s", "\n---\n\n"), F.lit("\n\n---\n\n"), failed, F.lit("\n"))
    told = F.to_json(F.struct(c("started").alias("startedAt"), c("finished").alias("finishedAt"), c("place").alias("cwd"), counted("s").alias("prompts"), counted("f").alias("searchFailureCases")))
    return rows.select("run_id", file_stamp(c("started")).alias("stamp"), markdown.alias("markdown"), told.alias("json"))
