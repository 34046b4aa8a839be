"""Exactly one row of a group of near duplicates stays, whatever the ids."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foragelake.llm import ngram_join


def _text(first: int, group: str = "w") -> str:
    return " ".join(f"{group}{k}" for k in range(first, first + 200))


def test_one_row_of_a_group_stays(spark):
    rows = [
        (1, _text(0), "a"), (1, _text(1), "b"), (1, _text(1), "c"), (1, _text(1), "c"), (2, _text(2), "d"), (None, _text(3), "e"),
        (None, _text(0, "x"), "f"), (None, _text(1, "x"), "g"), (None, _text(0, "x"), "f"), (1, _text(0, "y"), "h"), (7, "", "i"), (7, "", "i"),
    ]
    got = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    groups = [r["text"][:1] for r in got]
    assert sorted(groups) == ["", "", "w", "x", "y"]
    assert {(r["text"][:1], r["doc_id"]) for r in got} == {("", 7), ("w", 1), ("x", None), ("y", 1)}


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="finished"):
        ngram_join.connected(links, rounds=1)


def test_hot_passages_and_copies_by_both_joins(spark):
    """A passage in all documents, a class with a third of the rows, and the list of chosen documents joined both ways."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{_text(0, 'c')}") for i in range(30)] + [(100 + i, f"{passage} {_text(400 * i)}") for i in range(20)] + [(200 + i, f"{passage} {_text(400 * i + 5)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = ngram_join.materialize(ngram_join.signatures(docs, 5, 80), "test-signatures")
    ids = signed.groupBy("high", "low").agg({"row": "min"}).withColumnRenamed("min(row)", "class")
    found = [set(map(tuple, ngram_join.class_components(docs, signed, ids, 5, 80, n).collect())) for n in (0, 1000)]
    assert found[0] == found[1] and len(found[0]) == 40
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {**{i: 0 for i in range(30)}, **{100 + i: 100 + i for i in range(20)}, **{200 + i: 100 + i for i in range(20)}}


def test_crafted_words_have_hashes_of_their_own():
    """Thue-Morse words, which are alike to polynomials modulo 2**64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = ngram_join.shingles([word.encode(), other.encode()], 1)
    assert a != b


def test_links_between_components_that_share_hot_grams(spark, monkeypatch):
    """Many components share n-grams; blocks of one row find the same links as one block does."""
    rows = [(1000 * g + i, f"{_text(0, 'p')} " + " ".join(f"g{g}n{k + 3 * i}" for k in range(30))) for g in range(6) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for size in (1, 10**6):
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", size)
        got.append({r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 5, 80).collect()})
    from tests.llm.test_contracts import components

    assert got[0] == got[1] == {i: c for i, (_, c) in components(dict(rows), 5, 80).items()}


def test_a_very_frequent_gram_is_searched_in_bounded_groups(spark, monkeypatch):
    """More rows of an n-gram than blocks allow: the same links, and groups that don't grow with its frequency."""
    rng = random.Random(6)
    parts = [_text(300 * k, "t")[: 60 * 5] for k in range(40)]
    rows = [(i, " ".join([parts[0], *(parts[k] for k in sorted(rng.sample(range(1, 40), 5))), " ".join(f"u{i}x{j}" for j in range(rng.randrange(25)))])) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 3, 60).collect()}
    monkeypatch.setattr(ngram_join, "MOST_BLOCKS", 0)
    seen = []
    packed = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag, *a: seen.append(packed(df, tag, *a)) or seen[-1] if tag == "join-packs" else packed(df, tag, *a))
    for size in (8, 10**6):
        monkeypatch.setattr(ngram_join, "PACKED_ROWS", size)
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs, 3, 60).collect()} == want
    small, large = (df.select((F.length("class") / 8).alias("rows"), "packs") for df in seen)
    assert large.agg(F.max("packs"), F.max("rows")).first()[0] == 1
    assert small.agg(F.max("packs")).first()[0] >= 3 and small.agg(F.max("rows")).first()[0] < 40
    from tests.llm.test_contracts import components

    assert want == {i: c for i, (_, c) in components(dict(rows), 3, 60).items()}
    assert len(set(want.values())) > 1
