"""A cache with a time to live: which accesses hit.

An access hits while the entry that the last miss stored is younger than the time to live; a hit doesn't renew it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, event_id long, hit boolean"
#: States of a stream, over which its keys are spread.
BUCKETS = 4096


def _fold(ms: list[int], ttl_ms: int, expires: int | None) -> tuple[list[bool], int | None]:
    hits = []
    for now in ms:
        hit = expires is not None and expires > now
        hits.append(hit)
        if not hit:
            expires = now + ttl_ms
    return hits, expires


def cache_hits(accesses: DataFrame, ttl_ms: int, slice_ttls: int = 256) -> DataFrame:
    """(key, event_id, ms, ...) -> key, event_id, ..., hit. Accesses of a key are in the order of (ms, event_id).

    Rows with a null key or time are no accesses and are left out. An access that comes ttl_ms or more after the one
    before it is a miss whatever happened earlier, so a key falls into segments there, which are folded independently.
    Pauses are looked for in slices of time of slice_ttls times to live, and between slices by their edges, so that the rows
    of a hot key never meet in one task; only its slices do. An access that is a segment by itself needs no fold. Segments
    are streamed in sorted batches with one number of state. A key without a pause is one segment: its accesses depend on
    one another. Other columns are carried along.
    """
    more = [c for c in accesses.columns if c not in ("key", "event_id", "ms")]
    rows = accesses.select(F.col("key").cast("string").alias("key"), "event_id", "ms", F.struct(*[F.col(f"`{c}`") for c in more] or [F.lit(0).alias("_")]).alias("more")).filter("key IS NOT NULL AND ms IS NOT NULL")
    schema = T.StructType([*[rows.schema[c] for c in ("key", "event_id", "more")], T.StructField("hit", T.BooleanType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, expires = None, None
        for batch in batches:
            hits = []
            for k, segment, now in zip(batch["key"].to_pylist(), batch["segment"].to_pylist(), batch["ms"].to_pylist(), strict=True):
                if (k, segment) != at:
                    at, expires = (k, segment), None
                hit = expires is not None and expires > now
                if not hit:
                    expires = now + ttl_ms
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["event_id"], batch["more"], pa.array(hits, pa.bool_())], names=["key", "event_id", "more", "hit"])

    own = Window.partitionBy("key", "slice").orderBy("ms", "event_id")
    rows = rows.withColumn("slice", F.floor(F.col("ms") / (slice_ttls * ttl_ms)))
    rows = rows.withColumn("before", F.lag("ms").over(own)).withColumn("after", F.lead("ms").over(own)).withColumn("pause", F.coalesce(F.col("ms") - F.col("before") >= ttl_ms, F.lit(False)))
    rows = rows.withColumn("pauses", F.count_if("pause").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    along = Window.partitionBy("key").orderBy("slice")
    edges = rows.groupBy("key", "slice").agg(F.min("ms").alias("first"), F.max("ms").alias("last"), F.max("pauses").alias("inside"))
    edges = edges.withColumn("last_before", F.lag("last").over(along)).withColumn("first_after", F.lead("first").over(along))
    edges = edges.withColumn("opens", F.coalesce((F.col("first") - F.col("last_before") >= ttl_ms).cast("long"), F.lit(1).cast("long")))
    edges = edges.withColumn("earlier", F.sum(F.col("opens") + F.col("inside")).over(along) - F.col("inside"))
    rows = rows.join(edges.select("key", "slice", "last_before", "first_after", "opens", "earlier"), ["key", "slice"])
    begins = F.col("pause") | (F.col("before").isNull() & (F.col("opens") == 1))
    ends = F.coalesce(F.coalesce("after", "first_after") - F.col("ms") >= ttl_ms, F.lit(True))
    rows = rows.withColumn("segment", F.col("earlier") + F.col("pauses")).withColumn("alone", begins & ends)
    misses = rows.filter("alone").select("key", "event_id", "more", F.lit(False).alias("hit"))
    folded = rows.filter("NOT alone").select("key", "segment", "ms", "event_id", "more").repartition("key", "segment").sortWithinPartitions("key", "segment", "ms", "event_id")
    return misses.unionByName(folded.mapInArrow(fold, schema)).select("key", "event_id", *[F.col(f"more.`{c}`") for c in more], "hit")


def _result(keys: list[str], ids: list[int], hits: list[bool]) -> pd.DataFrame:
    kinds = {"key": "object", "event_id": "Int64", "hit": "bool"}
    return pd.DataFrame({n: pd.Series(v, dtype=kinds[n]) for n, v in (("key", keys), ("event_id", ids), ("hit", hits))})


class TtlCache(StatefulProcessor):
    """The same for a stream, in event time.

    A state holds a bucket of keys, since each call to it takes about as long as judging hundreds of accesses. Accesses wait
    until the watermark has passed them; then no earlier one can come, and they are judged in the order of (ms, event_id),
    each key by itself. The state of a bucket is what waits and the expiries of its keys' entries; a timer clears it.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, ms long, event_id long")
        self.expires = handle.getListState("expires", "key string, at long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """One timer a bucket: the earliest asked for."""
        old = self.timer.get()
        if old is None or at < old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            batch = batch[batch["key"].notna()]
            if len(batch):
                ids = [None if i is None else int(i) for i in batch["event_id"]]
                self.waiting.appendList(list(zip(batch["key"].tolist(), batch["ms"].tolist(), ids, strict=True)))
                least = int(batch["ms"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        yield _result([], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows, held = list(self.waiting.get()), dict(self.expires.get())
        due = sorted((r for r in rows if r[1] <= now), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
        rest = [r for r in rows if r[1] > now]
        hits = []
        for k, group in groupby(due, key=lambda r: r[0]):
            judged, held[k] = _fold([r[1] for r in group], self.ttl_ms, held.get(k))
            hits += judged
        if rest:
            self.waiting.put(rest)
            self._wake(min(r[1] for r in rest))
        elif rows:
            self.waiting.clear()
        # An entry that the watermark has passed may still count for what waits, as that came before.
        kept = {r[0] for r in rest}
        stay = [(k, at) for k, at in held.items() if at > now or k in kept]
        if stay:
            self.expires.put(stay)
            # A timer must lie ahead of the watermark, or it never fires; what waits is ahead of it.
            if not rest:
                self._wake(max(at for _, at in stay))
        elif held:
            self.expires.clear()
        yield _result([r[0] for r in due], [r[2] for r in due], hits)

    def close(self) -> None:
        pass


def stream_cache_hits(accesses: DataFrame, ttl_ms: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """cache_hits() of a streaming DataFrame (key, event_id, ms), in event time.

    An access is judged when the watermark, `delay` behind the latest time seen, has passed it, so accesses may come in any
    order within the delay; one that comes later is dropped. Rows with a null key are no accesses, but move the watermark;
    those with a null time are left out. What comes within the delay for a bucket of keys is held in its state. The number of
    buckets is part of a query's state, so it stays with its checkpoint.
    """
    rows = accesses.select(F.col("key").cast("string").alias("key"), "event_id", "ms", F.timestamp_millis("ms").alias("at")).filter("ms IS NOT NULL").withWatermark("at", delay)
    # Ids are texts on the way, as pandas would make floats of a column with nulls.
    bucket = F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.withColumn("event_id", F.col("event_id").cast("string")).withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(TtlCache(ttl_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
