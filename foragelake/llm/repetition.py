"""Quality rules: fixed counts for each text, and what a suffix array says about its repetitions.

A suffix array of the words of many texts at once is built by doubling: suffixes start sorted by (text, word), and each
round sorts those that aren't told apart yet by twice as many words. Suffixes of different texts never meet. The ranks of
all rounds give the longest common prefix of neighbours without another pass over the words.

The deepest LCP interval of a suffix has as its value the length of the longest repeat that starts there. A repeat that
isn't the rest of a longer one, starting a word before, is maximal. The union of maximal repeats of LEAST words or more is
what a text repeats, and a text is rejected when that is too large a part of it or one repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foragelake.llm.common import SPACE, blocks, table, text_or_empty

#: Words of a repeat that counts; the part of a text that repeats may cover; words of one repeat.
LEAST, MOST_COVERED, LONGEST = 8, 0.3, 100
#: The fixed rules.
FEWEST_WORDS, WINDOW, WINDOWS_PERCENT, SYMBOLS = 50, 3, 50, "#*$%&|<>"


class Repeats(NamedTuple):
    """Per word the longest repeat that starts there (0: none), and texts by the places of their first words."""

    longest: np.ndarray
    first: np.ndarray


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal ones for equal words, and where each text begins."""
    numbers: dict[bytes, int] = {}
    ids, first = [], [0]
    for t in texts:
        ids += [numbers.setdefault(w, len(numbers)) for w in t.split()]
        first.append(len(ids))
    return np.array(ids, np.int64), np.array(first)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """For each place of sorted keys, the first place with the same keys."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def repeats(texts: list[bytes]) -> Repeats:
    ids, first = _words(texts)
    n = len(ids)
    if n == 0:
        return Repeats(np.zeros(0, np.int64), first)
    end = np.repeat(first[1:], np.diff(first))
    key = np.repeat(np.arange(len(texts)), np.diff(first)) * (ids.max() + 1) + ids
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = _starts(key[order])
    levels, step = [], 1
    while True:
        # Suffixes that share their rank with another one; all others have their final place.
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(open_):
            break
        levels.append(rank)
        ahead = open_ + step
        then = np.where(ahead < end[open_], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        now = rank[open_].astype(np.int64)
        order = np.argsort(now * (n + 1) + then, kind="stable")
        now, then = now[order], then[order]
        rank = rank.copy()
        rank[open_[order]] = now + _starts(now, then) - _starts(now)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        at_a, at_b = a + common, b + common
        live = np.flatnonzero((at_a < end[a]) & (at_b < end[b]))
        same = live[levels[level][at_a[live]] == levels[level][at_b[live]]]
        common[same] += 1 << level
    deepest = np.zeros(n, np.int64)
    deepest[a] = common
    deepest[b] = np.maximum(deepest[b], common)
    return Repeats(deepest, first)


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges)[:n] > 0


_OUT = [
    ("doc_id", "long", pa.int64()), ("n_words", "long", pa.int64()), ("word_chars", "long", pa.int64()), ("n_symbols", "long", pa.int64()),
    ("n_dup_lines", "long", pa.int64()), ("n_repeat_words", "long", pa.int64()), ("n_maximal", "long", pa.int64()), ("covered_words", "long", pa.int64()),
    ("longest_repeat", "long", pa.int64()), ("spans", "array<struct<start:long,end:long>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
]


def _lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _rows(texts: list[bytes], least: int) -> Iterator[dict]:
    longest, first = repeats(texts)
    n = len(longest)
    inside = np.ones(n, bool)
    inside[first[:-1][first[:-1] < n]] = False
    before = np.where(inside, np.roll(longest, 1), 0) if n else longest
    maximal = (longest >= least) & (before <= longest)
    start = np.flatnonzero(maximal)
    held = covered(start, longest[start], n)
    windows = np.flatnonzero(longest >= WINDOW)
    repeated = covered(windows, np.full(len(windows), WINDOW), n)
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        chars = t.decode("utf-8")
        edges = np.flatnonzero(np.diff(np.concatenate([[0], held[a:b].astype(np.int8), [0]])))
        yield {
            "n_words": b - a,
            "word_chars": len(chars) - sum(map(chars.count, SPACE)),
            "n_symbols": sum(map(chars.count, SYMBOLS)),
            "n_dup_lines": _lines(t),
            "n_repeat_words": int(repeated[a:b].sum()),
            "n_maximal": int(maximal[a:b].sum()),
            "covered_words": int(held[a:b].sum()),
            "longest_repeat": int(longest[a:b].max(initial=0)),
            "spans": [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)],
        }


def _measured(least: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, kind) for name, _, kind in _OUT])
        for batch in batches:
            ids, at = batch["doc_id"].to_pylist(), 0
            for block in blocks((t or "").encode("utf-8", "replace") for t in batch["text"].to_pylist()):
                out = [{"doc_id": i, **row} for i, row in zip(ids[at : at + len(block)], _rows(block, least), strict=True)]
                at += len(block)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return measure


def quality_rules(docs: DataFrame, least: int = LEAST, most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """One row per document: doc_id, n_words, the four counts of the fixed rules, n_maximal (maximal repeats of `least`
    words or more), covered_words, longest_repeat, spans (what repeats, as places of words, ends exclusive), base_failed
    and kept.

    Words are runs without ASCII white space, compared as they are; symbols, lines and characters as the text has them. A
    repeat may overlap itself, as in "a a a", where "a a" is one. A text is kept when the fixed rules pass, at most
    `most_covered` of its words lie in repeats of `least` words or more, and no repeat is longer than `longest`.

    Null texts count as empty: no words, so base_failed. Repeated rows repeat their result, a null doc_id stays null, an
    empty table gives an empty result. Other columns are ignored, whatever their names. Each text is measured alone and
    whole, so one text bounds the memory: about 150 bytes for each of its words.
    """
    ddl = ", ".join(f"{name} {kind}" for name, kind, _ in _OUT)
    found = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_measured(least), ddl)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > WINDOWS_PERCENT * F.col("n_words"))
    good = (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return found.select("*", failed.alias("base_failed"), (~failed & good).alias("kept"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
