"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foragelake.llm import audio, chat, exact_dedup, licenses, mixing, ngram_join, packing, quality, secrets, sharding
from foragelake.llm.common import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, class long, gram long, `a.b` string, bucket int, rest int, size long, rank int, salt int, best string, draw long, span int"
LONG = "the quick brown fox jumps over " * 40_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "web", 0),
    (3, " \t\n", "en", "web", 3),
    (4, LONG, "en", "web", len(LONG)),
    (5, LONG, None, "web", len(LONG)),
    (6, "one two", "en", "books", 7),
    (6, "one two", "en", "books", 7),
    (7, "One Two", "en", None, 7),
    (None, "a null id: <|endoftext|> MIT License \\<|end|>", "en", "books", 9),
    (None, None, None, None, None),
    (8, "naïve ünïcode \U0001f600 CC BY 4.0", "fr", "books", 20),
    (9, " ".join(f"w{i}" for i in range(300)), "en", "books", 1),
    (10, " ".join(f"w{i}" for i in range(1, 301)), "en", "books", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ("x", 1, 2, "y", 3, 4, 5, 6, 7, "z", 8, 9)
    return spark.createDataFrame([(*r, *clash) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 0, None), (4, 1, None), (6, 1, 0), (9, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "mixing": mixing.mix,
        "copies": mixing.take_copies,
        "packing": packing.pack,
        "audio": audio.audio_features,
        "dedup": exact_dedup.report,
        "kept": exact_dedup.deduplicate,
        "join": ngram_join.near_duplicates,
        "near": ngram_join.drop_near_duplicates,
        "sharding": sharding.shard,
        "secrets": secrets.scan,
        "quality": lambda d: quality.classify(d, labels),
        "good": lambda d: quality.keep_good(d, labels),
        "licenses": licenses.scan,
    }


NAMES = list(operators(None))
EACH_ROW = ("mixing", "audio", "dedup", "join", "sharding", "secrets", "quality", "licenses")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, name):
    n = len(operators(labels)[name](docs).collect())
    assert n == len(ROWS) if name in EACH_ROW else n <= 10_000


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, name):
    assert operators(labels)[name](docs.filter("false")).collect() == []


@pytest.mark.parametrize("name", ["copies", "kept", "near", "good"])
def test_stages_keep_columns(docs, labels, name):
    assert operators(labels)[name](docs).columns == docs.columns


def test_dedup_of_nulls_ties_and_repeats(docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.report(docs).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True), (7, 7, 1, True)} <= got
    kept = exact_dedup.deduplicate(docs).collect()
    assert len(kept) == 9 and {r["doc_id"] for r in kept} == {2, 3, 5, 6, 7, None, 8, 9, 10}


def test_near_duplicates_of_odd_rows(docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()]
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 6, 4), (7, 1, 6), (10, 296, 9), (None, 0, None)} <= set(got)


def test_a_chain_is_one_component(spark):
    """Neighbours link, the ends of the chain don't."""
    rows = [(i, " ".join(f"w{k}" for k in range(8 * i, 8 * i + 200))) for i in range(30)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_word_counts(docs):
    got = {r["doc_id"]: r["n"] for r in docs.filter("doc_id IS NOT NULL").select("doc_id", word_count(F.col("text")).alias("n")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 240_000, 5: 240_000, 6: 2, 7: 2, 8: 6, 9: 300, 10: 300}


def test_permutation_is_a_bijection_and_invertible():
    for n in (1, 2, 3, 17, 1000, 4097):
        places = sharding.permute(np.arange(n), n)
        assert sorted(places.tolist()) == list(range(n))
        assert (sharding.permute(places, n, back=True) == np.arange(n)).all()
    shard, slot = sharding.shard_and_slot(123, 1000)
    assert sharding.row_number(shard, slot, 1000) == 123


def test_special_tokens_are_encoded_as_the_tokenizer_does(docs):
    text = ROWS[8][1]
    enc = packing.encoder("byte_bpe_50k")
    assert enc.encode(text) == packing.Tokenizer.from_file(enc.json).encode(text, add_special_tokens=False).ids


def test_plan_places_every_remainder_once():
    histogram = {1: 50, 7: 13, 300: 40, 511: 3, 640: 33, 1000: 9, 1023: 5}
    plan = packing.Plan(histogram)
    room = {}
    for length, n in histogram.items():
        for rank in range(n):
            pieces = sorted(plan.pieces(length, rank))
            assert sum(p[1] for p in pieces) == length and pieces[0][0] == 0
            for _, size, seq, at in pieces:
                room.setdefault(seq, []).append((at, size))
    assert sorted(room) == list(range(plan.sequences))
    for cells in room.values():
        end = 0
        for at, size in sorted(cells):
            assert at == end
            end += size
        assert end <= 1024


def test_wave_and_tensors_round_trip():
    for size in (64, 128, 64 * 1001):
        payload = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
        assert audio.decode_wave(audio.encode_wave(payload)) == (payload, audio.RATE)
    mel = np.random.default_rng(0).random((100, audio.MELS), dtype=np.float32)
    tensors, spans = audio.from_tensors(audio.to_tensors(mel, 1.6))
    assert tensors.shape == (2, audio.WINDOW, audio.MELS) and (tensors.reshape(-1, audio.MELS)[:100] == mel).all()
    assert spans[0][1] == spans[1][0] and len(spans) == 2


def test_resampling_keeps_a_low_tone_and_removes_a_high_one():
    t = np.arange(16_000) / 16_000
    low, high = (audio.resample(np.sin(2 * np.pi * f * t).astype(np.float32), 8000, 16_000) for f in (440, 6000))
    assert len(low) == 8000
    assert np.abs(low[200:-200] - np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)[200:-200]).max() < 0.01
    assert np.abs(high[200:-200]).max() < 0.01


def test_hysteresis():
    energy = np.array([0, 0, 0, 5, 0.2, -0.2, -3, 0, 0, 4, 0, 0, 0], float)
    assert audio.segments(energy) == [(3, 6), (9, 13)]


RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ("sharegpt", {"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ("instruction", {"instruction": "do", "input": "this", "output": "done", "system": "be kind"}, [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")]),
    ("instruction", {"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ("prompt", {"prompt": "p <|end|>\n<|turn:user|>", "completion": "\\<| \\\\ <\\|"}, [("user", "p <|end|>\n<|turn:user|>"), ("assistant", "\\<| \\\\ <\\|")]),
    ("question", {"question": "q", "answer": ""}, [("user", "q"), ("assistant", "")]),
    ("none", {"other": 1}, None),
]


def test_layouts_are_told_by_their_fingerprints(spark):
    rows = [(i, json.dumps(r)) for i, (_, r, _) in enumerate(RECORDS)] + [(98, "no json"), (99, None)]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, record string"))
    got = {r["conv_id"]: r for r in chats.select("*", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for i, (_, _, wanted) in enumerate(RECORDS):
        if wanted is None:
            assert i not in got
        else:
            assert [(t["role"], t["text"]) for t in got[i]["t"]] == wanted
            assert got[i]["loss"] == "".join(t for r, t in wanted if r == "assistant")
    assert 98 not in got and 99 not in got


def test_escape_is_reversible(spark):
    marks = ["", "\\", "<|", "<\\|", "\\<|", "\\\\<|", "<\\\\|", "<<||", "<|end|>\n", "\\n<\\|\\\\|"]
    got = spark.createDataFrame([(m,) for m in marks], "x string").select("x", chat.unescape(chat.escape(F.col("x"))).alias("y"), chat.escape(F.col("x")).alias("e")).collect()
    assert all(r["x"] == r["y"] and "<|" not in r["e"] for r in got)


def test_random_tokens_are_told_from_words(spark):
    """With models trained on the documents, random strings are found and long identifiers are left alone."""
    words = ["configuration_management_handler", "internationalization", "see/also/the/other/file/names", "under_the_water_of_the_river"]
    text = " ".join(words)
    random = "xK9vQ2mZ7pL4wR8tY3bN6"
    df = spark.createDataFrame([(1, f"{text} {random}"), (2, ""), (3, None)], "doc_id long, text string")
    ratio = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(df, ratio).collect()}
    start = len(text) + 1
    assert got == {1: f"markov:{start}:{start + len(random)}", 2: "", 3: ""}


def test_attention_finds_the_deciding_passage():
    """Bags whose label is that of one passage among many."""
    rng = np.random.default_rng(3)
    n = rng.integers(1, 12, 400)
    x = rng.normal(0, 1, (int(n.sum()), 6)).astype(np.float32)
    y = rng.integers(0, 2, 400).astype(float)
    at = np.cumsum(n) - n
    for i in np.flatnonzero(y):
        x[at[i] + rng.integers(0, n[i]), 0] = 6
    model = quality.fit(x, n, y)
    assert ((model.score(x, n) >= 0.5) == y).mean() > 0.95
