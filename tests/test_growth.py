"""What must not grow with the tables: rows of a task, pages in a Python worker, calls for each key of a stream."""

from __future__ import annotations

from foragelake.operators.search import top_candidates
from foragelake.plans import explore as X
from foragelake.plans.queries import QUERIES, _research_tables, research_inputs
from foragelake.sources.shared import dealt
from foragelake.streaming.ttl import stream_cache_hits
from tests.conftest import SF


def test_dealt_rows_stay_apart(spark):
    """Adaptive execution would merge such small partitions into one."""
    df = dealt(spark.range(1000), "id", rows=100)
    sizes = df.groupBy().count().first(), df.rdd.glom().map(len).collect()
    assert sizes[0][0] == 1000 and len(sizes[1]) == 10 and max(sizes[1]) < 200
    assert dealt(spark.range(0), "id").count() == 0


def test_calls_are_dealt_by_session(spark):
    plan = QUERIES["tool_call_times"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_pages_come_in_small_batches(spark):
    """An Arrow batch holds 10,000 pages whatever their length, a batch of plain functions a hundred."""
    for name in ("page_profile", "fetch_views", "html_title", "html_readable", "serp_outcome"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan, name


def test_stream_calls_follow_buckets(spark, tmp_path):
    """A state for each key took seconds for thousands of keys; keys of one bucket share one, and are judged apart."""
    rows = [(f"k{i % 300}", (1 << 53) + 1 + i, 1000 + (i // 300) * 40 + i % 7) for i in range(900)] + [("k0", None, 1055)]
    spark.createDataFrame(rows, "key string, event_id long, ms long").repartition(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(None, None, 10_000_000)], "key string, event_id long, ms long").repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("key string, event_id long, ms long").parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream_cache_hits(source, 60, "0 seconds", buckets=4).writeStream.format("memory").queryName("few_states").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(name)
    timers = sum(s["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for s in p["stateOperators"])
    found = {r["event_id"]: r["hit"] for r in spark.table("few_states").collect()}
    wanted, held = {}, {}
    for key, event, ms in sorted(rows, key=lambda r: (r[0], r[2], r[1] or 0)):
        wanted[event] = held.get(key, -1) > ms
        if not wanted[event]:
            held[key] = ms + 60
    assert found == wanted
    assert 0 < timers < 30, timers


def test_research_judges_pages_once(spark, monkeypatch):
    """Candidates are many times the pages: the patterns of texts, and the texts, stay with the pages."""
    held = {}

    def kept(df, tag, *more, write=X.written):
        held[tag] = df.columns, df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, tag, *more)

    monkeypatch.setattr(X, "written", kept)
    _, evidence = X.explore(*research_inputs(spark, SF))
    assert evidence.count() and set(evidence.columns) >= {"summary", "support"}
    for mark in ("just a moment", "not recommended"):
        assert {tag for tag, (_, plan) in held.items() if mark in plan} <= {"pages", "direct", "more"}, mark
    assert not {"text", "said", "summary", "support"} & {c for tag in ("direct", "reads", "best", "more") for c in held[tag][0]}
    assert "user experience" in held["steps"][1] and "user experience" not in held["reads"][1]


def test_plans_and_candidates_are_worked_out_once(spark):
    """Spark would work out a plan's array once more, to skip questions without one; a query goes not with each hit."""
    plan = X.steps_of(spark.sql("SELECT id AS query_id, concat('how to ', id) AS query FROM range(3)"))._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and plan.count("Generate") == 1
    hits = spark.sql("SELECT id AS query_id, id AS pos, 't' AS title, concat('https://a.b/', id % 3) AS url, 's' AS snippet, repeat('long query ', 99) AS query FROM range(9)")
    plan = top_candidates(hits.withColumn("query_id", hits.query_id % 2), "query_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "query" not in plan.split("Aggregate", 1)[1].split("\n")[0].replace("query_id", "")


def test_answers_are_counted_without_words(spark):
    assert "said" not in QUERIES["explore_answers"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_list_is_read_once_for_all_searches_that_found_it(spark, monkeypatch):
    """Searches are many times the lists; shared ones give what a copy for each search gives."""
    lists = _research_tables(spark, SF)
    held = {}

    def kept(df, tag, *more, write=X.written):
        held[tag] = write(df, tag, *more)
        return held[tag]

    monkeypatch.setattr(X, "written", kept)
    shared = [sorted(map(str, df.collect())) for df in X.explore(**lists)]
    found, reads = lists["searches"].select("found").distinct().count(), held["reads"].count()
    assert "step" not in held["reads"].columns and 0 < reads <= found * 2 * 4
    apart = [sorted(map(str, df.collect())) for df in X.explore(*research_inputs(spark, SF))]
    assert shared == apart and held["reads"].count() > 2 * reads


def test_words_are_collapsed_with_their_page(spark):
    """Not once more for each question that is told them: the pattern stands below the join with what is told."""
    plan = QUERIES["explore_views"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spots = [line for line in plan.split("\n") if "regexp_replace(said" in line]
    assert spots and not any("pos" in line for line in spots), spots
