"""Chats that used to lose turns."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from foragelake.llm import chat

OVER = 21_000_000


def test_a_turn_over_the_parser_limit_stays(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "x"), (2, 0, "assistant", "y")], "conv_id long, turn long, role string, text string")
    long = rows.withColumn("text", F.when(F.col("role") == "assistant", F.repeat("text", F.lit(OVER))).otherwise(F.col("text")))
    long.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.op8_format_chats(spark, str(tmp_path)).collect()}
    assert got[1] == (2, OVER) and got[2] == (1, OVER)


def test_a_json_record_over_the_parser_limit_fails(spark):
    record = F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("x"), F.lit(OVER)), F.lit('", "completion": "a"}'))
    with pytest.raises(Exception, match="can't be parsed"):
        chat.format_chats(spark.range(1).select(F.col("id").alias("conv_id"), record.alias("record"))).collect()


def test_typed_records_of_other_layouts(spark):
    got = chat.format_typed_chats(spark.sql("SELECT 1 AS conv_id, 'p' AS prompt, 'c' AS completion")).select(chat.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [tuple(t) for t in got] == [("user", "p"), ("assistant", "c")]


MIXED = [
    ({"prompt": "q", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "p"), ("user", "q"), ("assistant", "a")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"system": "s", "prompt": "p", "completion": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}, [("user", ""), ("assistant", "a")]),
]


def test_mixed_records_are_mapped_and_others_reported(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(MIXED)]
    rows += [(90, json.dumps({"messages": [{"role": "user", "content": "q"}], "answer": "a"})), (91, "no json"), (92, None)]
    records = spark.createDataFrame(rows, "conv_id long, record string")
    chats = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in chat.format_chats(records).select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert chats == {i: wanted for i, (_, wanted) in enumerate(MIXED)}
    told = {r["conv_id"]: r for r in chat.report_records(records).collect()}
    assert [told[i]["status"] for i in (*range(len(MIXED)), 90, 91, 92)] == ["mapped"] * len(MIXED) + ["unmapped", "unparsable", "missing"]
    assert told[90]["fingerprint"] is not None and told[91]["fingerprint"] is None
    assert [told[i]["n_turns"] for i in range(len(MIXED))] == [len(w) for _, w in MIXED]


WIDE = "conv_id long, system string, prompt string, completion string, messages array<struct<role:string,content:string,turn:long>>, conversations array<struct<`from`:string,value:string>>, question int, extra string"
TYPED = [
    (1, None, "p", "c", None, None, None, "x"),
    (2, "s", None, None, [("user", "q", 5), ("assistant", "a", 6)], None, None, None),
    (3, "s", None, None, None, [("human", "q"), ("gpt", "a")], None, "x"),
    (4, None, "p", None, None, [("human", "q"), ("gpt", None)], None, None),
    # No mapping: two layouts at once, none at all, an array without texts.
    (5, None, None, "c", [("user", "q", 0)], None, None, None),
    (6, None, None, None, None, None, 7, "x"),
    (7, None, None, None, [(None, None, 1)], None, None, None),
    (8, None, None, None, [], None, None, None),
]
WANTED = {1: [("user", "p"), ("assistant", "c")], 2: [("system", "s"), ("user", "q"), ("assistant", "a")], 3: [("system", "s"), ("user", "q"), ("assistant", "a")], 4: [("user", "p"), ("user", "q"), ("assistant", "")]}


def _typed(spark):
    chats = chat.format_typed_chats(spark.createDataFrame(TYPED, WIDE))
    return {r["conv_id"]: [tuple(t) for t in r["t"]] for r in chats.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}


def test_each_typed_row_is_mapped_by_its_own_fingerprint(spark):
    assert _typed(spark) == WANTED


def test_the_hash_selects_the_mapping(spark, monkeypatch):
    """With another hash on one side, no row finds its mapping."""
    real = F.md5
    monkeypatch.setattr(chat.F, "md5", lambda c: real(F.concat(c, F.lit("!"))))
    assert _typed(spark) == {}
