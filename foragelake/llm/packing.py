"""Packing documents into token sequences by cutting-stock column generation.

A document of n tokens gives n div 1024 full sequences of its own and one remainder. Packing the remainders with little
padding is a cutting-stock problem over a histogram of at most 1023 lengths, whatever the size of the corpus: a linear
program over patterns (how many remainders of which lengths share a sequence), whose columns are priced by a knapsack
dynamic program. Patterns are rounded down; what is left over, less than one sequence for each pattern, fills further
sequences and is cut where needed. Cuts of a length into two are columns of the same program. The remainders of each length are ranked, and rank intervals are handed to patterns,
so that a document's place follows from its length and rank by arithmetic.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foragelake.llm.common import bucket_count, materialize, table

CAPACITY = 1024
END_ID = 0
#: Buckets of each length at least; more where there are more rows.
BUCKETS = 256
#: Lengths are planned in steps of so many tokens; padding is about half a step for each piece.
STEP = 8
#: Column generation ends when no column improves the plan by more than GAP, or after PIVOTS steps. A cut of a remainder
#: counts as CUT_COST of a sequence, so only cuts that save more padding are made.
GAP, PIVOTS, CUT_COST = 0.002, 6000, 0.01


class Encoder:
    """Token ids of the byte-level BPE in `name`.json. The same vocabulary as ranks gives equal ids several times as fast."""

    def __init__(self, name: str):
        self.json = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = Tokenizer.from_file(self.json).get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}

    def encode(self, text: str) -> list[int]:
        for mark, number in self.special.items():
            if mark in text:
                ids: list[int] = []
                for i, part in enumerate(text.split(mark)):
                    ids += ([number] if i else []) + self.encode(part)
                return ids
        try:
            return self.fast.encode_ordinary(text)
        except Exception:  # noqa: BLE001  the fast matcher gives up on some very long runs of white space
            return Tokenizer.from_file(self.json).encode(text, add_special_tokens=False).ids


@cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def tokenize(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, draw (a hash of the row), n_tokens, ids (little-endian unsigned 16-bit, id 0 at the end)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(tokenizer).encode
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                ids = [np.array([*ids_of(t or ""), END_ID], "<u2") for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "draw": part["draw"], "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("draw"))
    return rows.mapInPandas(encode, f"doc_id {kind}, draw long, n_tokens long, ids binary")


# --- the plan, made on the driver from a histogram of at most 1023 numbers ---------------------------------------


def _knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best sum of prices within each capacity, and the last length used (0: none): unbounded dynamic program."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        m = min(c, len(prices))
        gain = value[c - m : c][::-1] + prices[:m]
        i = int(gain.argmax())
        if gain[i] > value[c - 1] + 1e-12:
            value[c], last[c] = gain[i], i + 1
        else:
            value[c] = value[c - 1]
    return value, last


def _pattern(last: np.ndarray, room: int, first: int, m: int) -> np.ndarray:
    """How many remainders of each length stand together: one of length `first`, and the best for the room left."""
    pattern = np.zeros(m)
    pattern[first - 1] = 1
    room -= first
    while room > 0:
        if last[room]:
            pattern[last[room] - 1] += 1
            room -= last[room]
        else:
            room -= 1
    return pattern


def solve(demand: np.ndarray, capacity: int, gap: float = GAP, pivots: int = PIVOTS, cut_cost: float = CUT_COST) -> tuple[np.ndarray, np.ndarray]:
    """Columns (one row each) and how often each is used, a fraction: revised simplex with generated columns.

    demand[i] remainders have length i + 1. A column is a pattern, with costs of one sequence; or the cut of one length
    into two (+1 for it, -1 for each part), which costs little and is priced along with the patterns.
    """
    m = len(demand)
    lengths = np.arange(1, m + 1)
    diagonal = (capacity // lengths).astype(float)
    columns = np.diag(diagonal)
    inverse = np.diag(1 / diagonal)
    cost = np.ones(m)
    # A little of every length keeps steps from having no effect.
    x = (demand + 1e-5 * (1 + np.random.default_rng(1).random(m))) / diagonal
    prices = cost @ inverse
    done = 0
    while done < pivots:
        value, last = _knapsack(prices, capacity)
        offers = [(float(v), int(i + 1), 0) for i, v in enumerate(prices + value[capacity - lengths] - 1)]
        for length in range(2, m + 1):
            half = length // 2
            parts = prices[:half] + prices[length - half - 1 : length - 1][::-1]
            i = int(parts.argmin())
            offers.append((float(prices[length - 1] - parts[i] - cut_cost), length, i + 1))
        offers = [o for o in sorted(offers, reverse=True) if o[0] > gap][:200]
        if not offers:
            break
        for _, length, part in offers:
            if part:
                column = np.zeros(m)
                column[length - 1] = 1
                column[part - 1] -= 1
                column[length - part - 1] -= 1
                price = cut_cost
            else:
                column, price = _pattern(last, capacity, length, m), 1.0
            used = np.flatnonzero(column)
            gain = float(prices[used] @ column[used]) - price
            if gain <= gap / 2:
                continue
            u = inverse[:, used] @ column[used]
            ratio = np.where(u > 1e-9, x / np.maximum(u, 1e-9), np.inf)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                continue
            x -= ratio[out] * u
            x[out] = ratio[out]
            np.maximum(x, 0, out=x)
            row = inverse[out] / u[out]
            rows = np.flatnonzero(np.abs(u) > 1e-12)
            inverse[rows] -= np.outer(u[rows], row)
            inverse[out] = row
            prices = prices - gain * row
            columns[out], cost[out] = column, price
            done += 1
    return columns, x


class Plan:
    """Where the remainder of each (length, rank) goes, and how many sequences there are.

    Lengths are planned in steps of `step` tokens. Inside a step, remainders are numbered by exact length and rank, so
    the histogram gives the exact length of each number, and offsets follow from it. Parts of cut remainders are
    numbered behind the whole ones of their step.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, step: int = STEP):
        self.capacity, self.step, self.sequences = capacity, step, 0
        m = -(-capacity // step)
        self.exact: list[tuple[list[int], list[int]]] = [([], []) for _ in range(m + 1)]
        total = np.zeros(m + 1, int)
        for length in sorted(histogram):
            c = -(-length // step)
            self.exact[c][0].append(int(total[c]))
            self.exact[c][1].append(length)
            total[c] += histogram[length]
        self.whole = total.copy()
        self.parts: list[list[tuple[int, int, int, int]]] = [[] for _ in range(m + 1)]
        self.cuts: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(m + 1)]
        self.runs: list[list[tuple[int, int, list, int]]] = [[] for _ in range(m + 1)]
        self.single: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        if total.any():
            self._assign(total)

    def _assign(self, total: np.ndarray) -> None:
        used = np.zeros(len(total), int)
        columns, times = solve(total[1:].astype(float), self.capacity // self.step)
        times = np.floor(times + 1e-3).astype(int)
        patterns, cuts = [], []
        for column, n in zip(columns.astype(int), times, strict=True):
            if n > 0:
                (cuts if (column < 0).any() else patterns).append((column, n))
        # Longest first, so that parts are there before they are cut again.
        for column, n in sorted(cuts, key=lambda c: -int(np.flatnonzero(c[0] > 0)[0])):
            whole, part = int(np.flatnonzero(column > 0)[0]) + 1, int(np.flatnonzero(column < 0)[0]) + 1
            n, first = int(min(n, total[whole] - used[whole])), int(used[whole])
            if n <= 0:
                continue
            a, total[part] = int(total[part]), total[part] + n
            b, total[whole - part] = int(total[whole - part]), total[whole - part] + n
            self.parts[part].append((a, 0, 0, part * self.step))
            self.parts[whole - part].append((b, whole, first, part * self.step))
            self.cuts[whole].append((first, n, part, a, b))
            used[whole] += n
        for column, n in patterns:
            steps = np.flatnonzero(column) + 1
            n = int(min([n, *((total - used)[steps] // column[steps - 1])]))
            if n <= 0:
                continue
            layout = [(int(c), int(column[c - 1]), int(used[c])) for c in steps[::-1]]
            for i, (c, a, first) in enumerate(layout):
                self.runs[c].append((first, i, layout, self.sequences))
                used[c] += a * n
            self.sequences += n
        self._fill([(self.length(c, k), c, k) for c in range(1, len(total)) for k in range(int(used[c]), int(total[c]))])

    def _fill(self, left: list[tuple[int, int, int]]) -> None:
        """What no whole use of a pattern takes: best fit, then sequences with much room are cut full."""
        room: list[tuple[int, list]] = []
        for item in sorted(left, reverse=True):
            at = bisect_left(room, (item[0],))
            free, items = room.pop(at) if at < len(room) else (self.capacity, [])
            insort(room, (free - item[0], [*items, item]))
        rest = []
        for free, items in room:
            if free > self.capacity // 64:
                rest += items
                continue
            at = 0
            for size, c, k in items:
                self.single[c, k] = [(0, size, self.sequences, at)]
                at += size
            self.sequences += 1
        at = 0
        for size, c, k in rest:
            begin = 0
            while begin < size:
                part = min(size - begin, self.capacity - at)
                self.single.setdefault((c, k), []).append((begin, part, self.sequences, at))
                begin, at = begin + part, at + part
                if at == self.capacity:
                    self.sequences, at = self.sequences + 1, 0
        self.sequences += at > 0

    def length(self, c: int, k: int) -> int:
        """Exact length of number k of step c."""
        if k < self.whole[c]:
            first, lengths = self.exact[c]
            return lengths[bisect_right(first, k) - 1]
        first, whole, number, size = self.parts[c][bisect_right(self.parts[c], k, key=lambda p: p[0]) - 1]
        return self.length(whole, number + k - first) - size if whole else size

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of each piece of a remainder."""
        c = -(-length // self.step)
        first, lengths = self.exact[c]
        return self._at(c, first[bisect_left(lengths, length)] + rank)

    def _at(self, c: int, k: int) -> list[tuple[int, int, int, int]]:
        for first, n, part, a, b in self.cuts[c]:
            if first <= k < first + n:
                i = k - first
                size = part * self.step
                return self._at(part, a + i) + [(s + size, *rest) for s, *rest in self._at(c - part, b + i)]
        if (c, k) in self.single:
            return self.single[c, k]
        first, i, layout, sequence = self.runs[c][bisect_right(self.runs[c], k, key=lambda r: r[0]) - 1]
        a = layout[i][1]
        nth, slot = divmod(k - first, a)
        before = [(d, at + nth * b + j) for d, b, at in layout[:i] for j in range(b)] + [(c, first + nth * a + j) for j in range(slot)]
        return [(0, self.length(c, k), sequence + nth, sum(self.length(*x) for x in before))]


# --- the distributed part -----------------------------------------------------------------------------------------


def _ranked(tokens: DataFrame, capacity: int, buckets: int) -> DataFrame:
    """tokens + rest (length of the remainder), rank (among equal rests, from 0), chunk (full sequences before it).

    Running counts are two-level, per bucket of the row hash and inside it, so that a length which a third of all
    documents have is spread over `buckets` groups.
    """
    rows = tokens.withColumn("rest", F.col("n_tokens") % capacity).withColumn("full", F.floor(F.col("n_tokens") / capacity))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("draw", 65 - buckets.bit_length()))
    cells = rows.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("full").alias("chunks"))

    def before(name: str, *keys: str, by: str):
        over = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(over), F.lit(0))

    by_rest = cells.groupBy("rest").agg(F.sum("chunks").alias("chunks")).select("rest", before("chunks", by="rest").alias("rest_chunk"))
    cells = cells.select("rest", "bucket", before("rows", "rest", by="bucket").alias("cell_rank"), before("chunks", "rest", by="bucket").alias("cell_chunk"))
    cells = cells.join(by_rest, "rest")
    own = Window.partitionBy("rest", "bucket").orderBy("draw", "doc_id", "n_tokens")
    placed = rows.withColumn("at", F.row_number().over(own) - 1).withColumn("chunk_at", F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(cells, ["rest", "bucket"])
    return placed.select("doc_id", "n_tokens", "ids", "rest", (F.col("cell_rank") + F.col("at")).alias("rank"), (F.col("rest_chunk") + F.col("cell_chunk") + F.col("chunk_at")).alias("chunk"))


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, least_buckets: int = BUCKETS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every document ends with id 0, so null and empty texts are one token. Each id is in one piece. A sequence holds at
    most `capacity` tokens, its pieces are gapless from offset 0, and sequence ids are gapless from 0. Every row is a
    document of its own, also where doc_ids repeat or are null. An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    tokens = materialize(tokenize(docs, tokenizer), "pack-tokens")
    # At most `capacity` rows.
    histogram = tokens.groupBy((F.col("n_tokens") % capacity).alias("rest")).count().collect()
    buckets = bucket_count(max((int(r["count"]) for r in histogram), default=0), least_buckets)
    plan = Plan({int(r["rest"]): int(r["count"]) for r in histogram if r["rest"]}, capacity)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                rows = []
                for doc_id, n, ids, rest, rank, chunk in batch.iloc[lo : lo + 500].itertuples(index=False, name=None):
                    own = [(i * capacity, capacity, plan.sequences + chunk + i, 0) for i in range(n // capacity)]
                    if rest:
                        own += [(n - rest + a, b, s, o) for a, b, s, o in plan.pieces(rest, rank)]
                    wide = np.frombuffer(ids, "<u2").astype("<u4")
                    rows += [(doc_id, a, b, wide[a : a + b].tobytes(), n, s, o) for a, b, s, o in own]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return _ranked(tokens, capacity, buckets).mapInPandas(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
