"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, checksum of the text, size); rows alike in all three in any order. A
keyed Feistel network permutes the smallest even-bit domain
that holds n, and walks its cycle until it lands below n: a bijection of 0..n-1. Row number r at place p goes to shard
p mod shards, slot p div shards. So shard and slot of any row, and the row of any shard and slot, can be computed
without a table, counts of shards differ by one at most, and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foragelake.llm.common import materialize, mix, table, text_or_empty

SHARDS = 40
SEED = 20240607
ROUNDS = 6


def _keys(seed: int, rounds: int) -> np.ndarray:
    return mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix(left + k) & mask), left
        else:
            left, right = right, left ^ (mix(right + k) & mask)
    return (left << np.uint64(half)) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """Places of row numbers in the shuffle of 0..n-1; with back, the row numbers of places."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = _keys(seed, rounds)
    out = _network(np.asarray(rows, np.uint64), half, keys, back)
    # The domain is less than 4n, so about every second value still walks in each turn.
    while (walking := out >= np.uint64(n)).any():
        out[walking] = _network(out[walking], half, keys, back)
    return out.astype(np.int64)


def shard_and_slot(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    place = int(permute(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def row_number(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(df: DataFrame, *by: str) -> DataFrame:
    """df with a gapless `row_number` from 0 in the order of `by`.

    Rows are range-partitioned and sorted once; row numbers are places in a partition plus the rows of the partitions
    before it, so only one count for each partition is gathered. Rows with equal `by` get numbers in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c).asc_nulls_first() for c in by]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("__part", F.shiftright("__at", 33)), "row-numbers")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    return ranged.join(starts, "__part").withColumn("row_number", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__start")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot.

    A null text has no bytes: size 16 and the checksum of nothing, 0. Null doc_ids come first in the numbering. Rows
    that repeat doc_id and text get different, interchangeable places. With fewer rows than shards some shards stay
    empty; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    narrow = docs.select("doc_id", (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    numbered = materialize(number_rows(narrow, "doc_id", "text_crc32", "size"), "shard-rows")
    n = numbered.count()

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), n, seed))

    placed = numbered.withColumn("place", place("row_number"))
    return placed.select("doc_id", "size", "text_crc32", "row_number", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
