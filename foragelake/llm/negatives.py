"""Hard negatives: for each anchor and positive, rows of other labels that score nearly as high as the positive.

Scores are integer inner products. Vectors are packed into blocks once: rows into blocks as they are read, anchors (a
stated, much smaller set) into blocks by a hash of their id. Each pair of a row block and an anchor block is one group of
bounded size. In it all scores of each anchor are sorted by score and id, and that order is read from a binary search.

1. Each group gives its best rows of the anchor's own label; the best of all groups are the positives.
2. Each group searches, for each positive, the highest score allowed, and reads the first different-label rows from there
   down to the lowest score allowed; the best of all groups are the negatives.

A group gives only as many rows as the result may have, so what is shuffled doesn't grow with the pairs compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foragelake.llm.common import discard, materialize, table

#: Vectors of a row block, and of an anchor block at least; rows whose scores are sorted at once.
ROWS_EACH, ANCHORS_EACH, SORTED_AT_ONCE = 1 << 14, 128, 16
_LONG = (1 << 63) - 1


def _whole(vectors: pa.ListArray | pa.LargeListArray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, x as double; shorter vectors end in zeros."""
    size = np.asarray(vectors.value_lengths(), np.int64)
    flat = np.asarray(vectors.flatten().cast(pa.float64()))
    out = np.zeros((len(size), int(size.max(initial=0))))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = np.floor(scale * flat)
    return out


def _packed(scale: float, each: int):
    """Vectors into blocks: ids, labels, and whole components as doubles, which hold them exactly."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held, rows = [], 0

        def block() -> pa.RecordBatch:
            nonlocal held, rows, k
            t = pa.Table.from_batches(held).combine_chunks()
            held, rows, k = [], 0, k + 1
            values = _whole(t["vector"].combine_chunks(), scale)
            one = [(part << 32) + k, t["id"].to_numpy().astype("<i8").tobytes(), t["label"].to_numpy().astype("<i8").tobytes(), values.shape[1], values.astype("<f8").tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(("block", "ids", "labels", "width", "values"), one, strict=True))], schema=_BLOCK)

        for batch in batches:
            while len(batch):
                head = batch.slice(0, each - rows)
                held.append(head)
                rows += len(head)
                batch = batch.slice(len(head))
                if rows == each:
                    yield block()
        if rows:
            yield block()

    return pack


_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("values", pa.binary())])
_BLOCK_DDL = "block long, ids binary, labels binary, width int, values binary"


def _opened(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and components of the one block of a group, in the order of ids."""
    row = t.slice(0, 1).to_pylist()[0]
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    values = np.frombuffer(row["values"], "<f8").reshape(len(ids), row["width"])
    order = np.argsort(ids, kind="stable")
    return ids[order], labels[order], values[order]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; beyond the range of a long, its ends."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    big = [[int(x) for x in row] for row in b]
    one = ([max(-_LONG, min(_LONG, sum(p * q for p, q in zip(x, y, strict=True)))) for y in big] for x in ([int(v) for v in row] for row in a))
    return np.array(list(one), np.int64).reshape(len(a), len(b))


def ranked(found: np.ndarray) -> np.ndarray:
    """Places of each row's scores from the highest down, equal ones in the order of columns."""
    n = found.shape[1]
    bits = n.bit_length()
    if np.abs(found).max(initial=0) < 1 << (62 - bits):
        # Score and place in one number sort much faster than two keys, to the same order.
        return np.sort((-found << bits) | np.arange(n), axis=1) & ((1 << bits) - 1)
    return np.argsort(-found, axis=1, kind="stable")


def _each_anchor(anchors: pa.Table, rows: pa.Table):
    """Per anchor: its place and id, and scores, ids and own-label flags of all rows of the block, best first."""
    ids, labels, values = _opened(rows)
    a_ids, a_labels, a_values = _opened(anchors)
    for at in range(0, len(a_ids), SORTED_AT_ONCE):
        found = scores(a_values[at : at + SORTED_AT_ONCE], values)
        for k, order in enumerate(ranked(found), at):
            order = order[ids[order] != a_ids[k]]
            yield a_ids[k], found[k - at][order], ids[order], labels[order] == a_labels[k]


def _positives(most: int):
    def best(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            for anchor, score, ids, own in _each_anchor(anchors, rows):
                place = np.flatnonzero(own)[:most]
                out += [(anchor, i, s) for i, s in zip(ids[place], score[place], strict=True)]
        cols = np.array(out, np.int64).reshape(-1, 3).T
        return pa.table({"anchor_id": cols[0], "positive_id": cols[1], "positive_score": cols[2]})

    return best


def limits(positive: int, low: int, high: int, of: int) -> tuple[int, int]:
    """Smallest and largest n with low * positive <= of * n <= high * positive."""
    return max(-_LONG, -(-low * positive // of)), min(_LONG, high * positive // of)


def _negatives(most: int, low: int, high: int, of: int):
    def best(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            known = dict(zip(*(anchors[c].to_pylist()[0] for c in ("anchor_ids", "positives")), strict=True))
            for anchor, score, ids, own in _each_anchor(anchors, rows):
                other, falling = ids[~own], -score[~own]
                for p in known[anchor]:
                    least, largest = limits(p["positive_score"], low, high, of)
                    start = np.searchsorted(falling, -largest)
                    stop = min(start + most, np.searchsorted(falling, -least, side="right"))
                    out += [(anchor, p["place"], p["positive_id"], p["positive_score"], i, -s) for i, s in zip(other[start:stop], falling[start:stop], strict=True)]
        cols = np.array(out, np.int64).reshape(-1, 6).T
        names = ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table(dict(zip(names, cols, strict=True)))

    return best


def _sound(df: DataFrame, scale: float) -> Column:
    """Whether a row takes part: no null in it, every component finite."""

    def finite(x: Column) -> Column:
        y = x.cast("double")
        return F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")) & (F.abs(y * scale) < float("inf")), F.lit(False))

    return F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, of: int = 100, scale: float = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Both inputs have (id, label, vector). A score is the inner product of floor(scale * component). An anchor's positives
    are its `positives` best other rows of its label; its negatives, for each, the `negatives` best rows of other labels
    with low/of * positive <= score <= high/of * positive. Equal scores go by smaller id.

    Rows with a null id, label, vector or component, or with a component that isn't finite, take no part. Vectors may
    differ in length: what is missing counts 0. Repeated rows are rows like others, except that a row never is a
    positive of an anchor of its id; anchors of one id are one anchor, the one with the smallest (label, vector). Scores
    beyond a long are its ends. An anchor without positives, a positive without negatives and an empty table give no
    rows. Other columns are ignored, whatever their names.
    """
    rows, anchors = (d.select("id", F.col("label").cast("long").alias("label"), "vector").filter(_sound(d, scale)) for d in (rows, anchors))
    anchors = anchors.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector")
    anchors = materialize(anchors, "anchors")
    many = anchors.count()
    parts = max(1, -(-many // max(ANCHORS_EACH, min(1 << 12, many >> 8))))
    packed = materialize(rows.mapInArrow(_packed(scale, ROWS_EACH), _BLOCK_DDL), "vectors")
    blocks = packed.select(F.col("block").alias("row_block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def grouped(known: DataFrame) -> DataFrame:
        """Blocks of anchors, one for each block of rows."""
        one = known.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

        def pack(t: pa.Table) -> pa.Table:
            values = _whole(t["vector"].combine_chunks(), scale)
            cells = [t["part"][0].as_py(), t["id"].to_numpy().astype("<i8").tobytes(), t["label"].to_numpy().astype("<i8").tobytes(), values.shape[1], values.astype("<f8").tobytes(), t["id"].to_pylist(), t["positives"].to_pylist()]
            return pa.Table.from_pylist([dict(zip(("part", "ids", "labels", "width", "values", "anchor_ids", "positives"), cells, strict=True))], schema=made)

        place = pa.struct([("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
        made = pa.schema([("part", pa.int32()), *list(_BLOCK)[1:], ("anchor_ids", pa.list_(pa.int64())), ("positives", pa.list_(pa.list_(place)))])
        ddl = f"part int, {_BLOCK_DDL.split(', ', 1)[1]}, anchor_ids array<long>, positives array<array<struct<place:int,positive_id:long,positive_score:long>>>"
        return one.groupBy("part").applyInArrow(pack, ddl).join(blocks, "part")

    def in_blocks(known: DataFrame, best, ddl: str) -> DataFrame:
        return dealt.groupBy("part", "block").cogroup(grouped(known).groupBy("part", "row_block")).applyInArrow(best, ddl)

    def first(found: DataFrame, most: int, keys: list[str], score: str, id_: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), id_)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    none = F.array().cast("array<struct<place:int,positive_id:long,positive_score:long>>")
    near = in_blocks(anchors.withColumn("positives", none), _positives(positives), "anchor_id long, positive_id long, positive_score long")
    near = first(near, positives, ["anchor_id"], "positive_score", "positive_id")
    near = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("rank").alias("place"), "positive_id", "positive_score")).alias("positives"))
    known = materialize(anchors.join(near, "id"), "positives")
    found = in_blocks(known, _negatives(negatives, low, high, of), "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = first(found, negatives, ["anchor_id", "place"], "negative_score", "negative_id")
    out = materialize(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "place"), "negatives")
    discard(anchors, packed, known)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, rows.filter(F.col("id") % 100 == 0)).drop("place")


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS own, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, id, score FROM s WHERE own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.own
WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10
"""
