"""Helpers that several corpus operators share: tables, shared storage, word counts and word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foragelake.sources.shared import discard, shared_dir
from foragelake.sources.shared import written as materialize

__all__ = ["SPACE", "Words", "blocks", "bucket_count", "discard", "materialize", "mix", "shared_dir", "shingles", "table", "text_or_empty", "word_count"]

#: ASCII white space: what separates words everywhere here.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(rows: int, least: int, rows_each: int = 100_000, most: int = 1 << 20) -> int:
    """A power of two of buckets, so that one of them holds about rows_each rows at most."""
    return min(most, max(least, 1 << max(0, -(-rows // rows_each) - 1).bit_length()))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


# --- vectorised word hashing, for Arrow batches inside tasks -----------------------------------------------------

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of some texts: byte starts and ends in `data`, a 64-bit hash each, and `first[i]:first[i+1]` for text i.

    Words are runs of bytes other than ASCII white space; A-Z count as a-z in hashes.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ws = _WS[self.data]
        edge = np.flatnonzero(ws[1:] != ws[:-1]) + 1
        if len(ws) and not ws[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, at)

    def hashes(self) -> np.ndarray:
        """The sum, over a word's bytes, of a pseudo-random number for each byte and place in the word.

        So no rule of arithmetic makes long crafted words alike, as it does with polynomials modulo 2**64.
        """
        size = self.end - self.start
        at = np.repeat(self.start, size)
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        key = (place.astype(np.uint64) << np.uint64(8)) | _LOWER[self.data[at + place]].astype(np.uint64)
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(mix((key + np.uint64(1)) * np.uint64(_P)), out=total[1:])
        last = np.cumsum(size)
        return mix(total[last] - total[last - size] + size.astype(np.uint64))


def blocks(texts: Iterable[bytes], limit: int = 1 << 21) -> Iterator[list[bytes]]:
    """Runs of texts of about `limit` bytes in all, so that scratch arrays stay small."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingles(texts: Iterable[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; with fewer words, the whole sequence as one."""
    for block in blocks(texts):
        words = Words(block)
        h = words.hashes()
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for i in range(width):
            rolled = mix(rolled * np.uint64(_P) + h[i : i + len(rolled)])
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            else:
                short = np.full(min(1, b - a), b - a, np.uint64)
                for x in h[a:b]:
                    short = mix(short * np.uint64(_P) + x)
                yield short
