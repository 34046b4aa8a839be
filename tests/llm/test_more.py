"""Chats with odd rows, segments against a plain loop, rare labels of long documents, and buckets."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foragelake.llm import audio, chat, packing, quality
from foragelake.llm.common import bucket_count

CHAT = "conv_id long, turn long, role string, text string, record string, turns_ string, formatted string, head string"


def test_chats_of_odd_rows(spark):
    """Null ids, turns, roles and texts, repeats and ties, very long texts, an empty table and clashing columns."""
    long = "x <|end|>\n\\ " * 200_000
    rows = [(None, None, None, None), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 0, "assistant", ""), (1, None, "assistant", long), (2, 5, "tool <|x", None)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CHAT)
    chats = chat.format_typed_chats(chat.conversation_records(docs))
    got = {r["conv_id"]: r for r in chats.select("*", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert {k: [tuple(t) for t in r["t"]] for k, r in got.items()} == {None: [("", "")], 1: [("assistant", ""), ("assistant", long), ("user", "q"), ("user", "q")], 2: [("tool <|x", "")]}
    assert got[1]["loss"] == long and got[2]["loss"] == ""
    assert chat.format_typed_chats(chat.conversation_records(docs.filter("false"))).collect() == []


def test_segments_and_energy_by_a_plain_loop(spark):
    text = "a" * 900 + "".join(chr(33 + 61 * k % 90) for k in range(2000)) + "b" * 1500
    row = audio.audio_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    x = [(b - 128) / 128 for b in bytes(row["payload"])]
    taps = audio._filters(1, 2)[0]
    padded = [0.0] * (2 * audio.TAPS) + x + [0.0] * (4 * audio.TAPS)
    low = [sum(t * padded[2 * n + k] for k, t in enumerate(taps)) for n in range(-(-len(x) // 2))]
    frames = max(1, -(-max(0, len(low) - 256) // 128) + 1)
    low += [0.0] * (frames * 128 + 256)
    energy = [10 * math.log10(sum(v * v for v in low[128 * n : 128 * n + 256]) / 256 + 1e-6) for n in range(frames)]
    middle, active, wanted = float(np.median(energy)), False, []
    for n, e in enumerate(energy):
        now = True if e - middle >= 1 else False if e - middle < -0.5 else active
        if now and not active:
            wanted.append([n, n])
        if now:
            wanted[-1][1] = n + 1
        active = now
    assert [x for s in row["segments"] for x in (s["start_s"], s["end_s"])] == pytest.approx([0.016 * k for ab in wanted for k in ab])
    assert f"frames={frames};" in row["summary"] and f"segments={len(wanted)};" in row["summary"] and wanted


def test_ids_are_those_of_the_tokenizer():
    """The fast encoder against the tokenizer itself, on strings of many scripts and signs."""
    enc, rng = packing.encoder("byte_bpe_50k"), np.random.default_rng(4)
    signs = list("abcXYZ 019\n\t.,'\"-_äßéñ中文日本한국🙂👍🏽‍  <|>\\") + ["'s", "  ", "<|endoftext|>"]
    tok = packing.Tokenizer.from_file(enc.json)
    for n in range(300):
        text = "".join(signs[i] for i in rng.integers(0, len(signs), 1 + n))
        assert enc.encode(text) == tok.encode(text, add_special_tokens=False).ids
    for text in ("a" * 20_000, " " * 20_000, "ab " * 20_000):
        assert enc.encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_bad_documents_are_told_from_good_ones(spark):
    """Recall and precision of label 0 on the held-out fold, and of long documents by themselves."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op9_quality(spark, sf).join(labels, "doc_id").join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    bad = [r for r in got if r["quality"] == 0]
    told = [r for r in got if r["predicted"] == 0]
    assert len(bad) > 5 and sum(r["predicted"] == 0 for r in bad) >= 0.8 * len(bad) and sum(r["quality"] == 0 for r in told) >= 0.8 * len(told)
    large = [r for r in got if r["n"] > 6000]
    assert all(r["predicted"] == r["quality"] for r in large) or sum(r["predicted"] == r["quality"] for r in large) >= 0.9 * len(large)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in quality.classify(docs, labels).filter("predicted = 1").collect()}


def test_bucket_counts():
    assert [bucket_count(n, 256) for n in (0, 1, 10**7, 10**8, 10**13)] == [256, 256, 256, 1024, 1 << 20]
