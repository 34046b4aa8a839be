"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue. A document that enters its queue in shuffled order gets the virtual finish time

    (words of its source up to and including it) / (target of its source)

and the mix is the prefix of all queues merged by finish time whose words fill the budget. Because times are divided
by the target, all sources reach time 1 together, just when the budget is spent.

Both running sums (inside a source, and over the merged order) are two-level: totals per bucket first, then a running
sum inside a bucket. So one source with a third of all rows is still spread over `buckets` groups, and nothing passes
through one task but totals, of which there are at most buckets per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foragelake.llm.common import bucket_count, materialize, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
#: Buckets at least; more where there are more rows. The order doesn't depend on their number.
BUCKETS = 2048


def _running(before: bool, *keys: str, by: list[str]) -> Window:
    end = -1 if before else Window.currentRow
    return Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, end)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source_key, source_size) -> + target, one row per source.

    The budget is `share` of all words. Sources get it by weight, but never more than `repeats` times their size; the
    excess is shared again by weight among the rest until none is above. In order of size/weight the capped sources
    come first, so the level is found with running sums over the list of sources instead of a loop.
    """
    order = Window.orderBy(F.col("source_key").isNull(), F.col("source_key").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy("ratio", F.col("source_key").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        ranked.withColumn("cap", F.col("source_size") * repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("weight_left"))
        .withColumn("cut", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything))
    )
    target = F.when(F.col("cut").isNull() | (F.col("ratio") < F.col("cut.ratio")), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("cut.level")))
    return levelled.select("source_key", "source_size", target.alias("target"), "budget")


def mix(docs: DataFrame, seed: int = 17, least_buckets: int = BUCKETS, **targets) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies (how often the mix takes the row).

    Null and blank texts have size 0 and are never taken. Null sources are one source, which comes last. Repeated rows
    stay repeated: each counts. Where all sizes are 0, all targets are 0. An empty table gives an empty result. Other
    columns are ignored, whatever their names. The budget may end inside one document, which is then left out; so a
    source misses its target by about one document at most. Rows alike in doc_id and text have one place in the order
    and so one bucket; the list of sources (not of rows) passes through one task.
    """
    sized = docs.select(
        "doc_id",
        F.col("source").alias("source_key"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
    )
    # Narrow rows: reading them again is far cheaper than counting words again.
    sized = materialize(sized, "mix-sizes")
    buckets = bucket_count(sized.count(), least_buckets)
    sized = sized.withColumn("bucket", F.shiftrightunsigned("draw", 64 - (buckets - 1).bit_length()))
    cells = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("cell_size"))
    targets_by_source = source_targets(cells.groupBy("source_key").agg(F.sum("cell_size").alias("source_size")), **targets)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(_running(True, "source_key", by=["bucket"])), F.lit(0)))
    t, c = targets_by_source.alias("t"), cells.alias("c")
    starts = c.join(t, F.col("t.source_key").eqNullSafe(F.col("c.source_key"))).select("c.source_key", "bucket", "cell_before", "source_size", "target", "budget")
    s, d = starts.alias("s"), sized.alias("d")
    queued = (
        d.join(s, F.col("d.source_key").eqNullSafe(F.col("s.source_key")) & (F.col("d.bucket") == F.col("s.bucket")))
        .select("d.*", "s.cell_before", "s.source_size", "s.target", "s.budget")
        .withColumn("queued", F.col("cell_before") + F.sum("size").over(_running(False, "source_key", "bucket", by=["draw", "doc_id", "size"])))
    )
    queued = materialize(queued.drop("cell_before", "bucket"), "mix-queues")

    # A row may be taken once in every round through its source; round k comes k source sizes later.
    rounds = targets.get("repeats", MOST_REPEATS)

    def finish(k: Column) -> Column:
        return (F.col("queued") + k * F.col("source_size")) / F.col("target")

    takes_part = (F.col("size") > 0) & (F.col("target") > 0)
    entries = (
        queued.filter(takes_part)
        .withColumn("round", F.explode(F.array(*map(F.lit, range(rounds)))))
        .withColumn("finish", finish(F.col("round")))
        # Targets add up to the budget, so equal spans of finish time hold about equally many words.
        .withColumn("span", F.least(F.floor(F.col("finish") * buckets), F.lit(2 * buckets)))
    )
    spans = entries.groupBy("span", "budget").agg(F.sum("size").alias("words"))
    spans = spans.withColumn("before", F.coalesce(F.sum("words").over(_running(True, by=["span"])), F.lit(0)))
    # Spans that end before the budget does are taken whole, those that begin after it not at all: only the span in
    # which it ends has to be sorted for the place of the cut.
    last = spans.filter(F.col("before") < F.col("budget")).agg(F.max(F.struct("span", "before")).alias("x")).first()["x"]
    if last is None:
        copies = F.lit(0)
    else:
        place = ["finish", "draw", "queued", "round"]
        merged = F.lit(last["before"]) + F.sum("size").over(_running(False, "span", by=place))
        cut = entries.filter(F.col("span") == last["span"]).withColumn("merged", merged).filter(F.col("merged") <= F.col("budget")).agg(F.max(F.struct(*place)).alias("x")).first()["x"]
        whole = F.lit(last["span"]) if cut is None else None

        def within(k: int) -> Column:
            at = F.struct(finish(F.lit(k)).alias("finish"), F.col("draw"), F.col("queued"), F.lit(k).alias("round"))
            if whole is not None:
                return F.floor(at["finish"] * buckets) < whole
            return at <= F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["draw"]).alias("draw"), F.lit(cut["queued"]).alias("queued"), F.lit(cut["round"]).alias("round"))

        counted = [F.when(within(k), 1).otherwise(0) for k in range(rounds)]
        copies = F.when(takes_part, sum(counted[1:], counted[0])).otherwise(0)
    return queued.withColumn("copies", copies.cast("int")).select(
        "doc_id", F.col("source_key").alias("source"), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies", "draw"
    )


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns; see mix().

    The mix names rows by doc_id, source and a hash of doc_id and text, so rows equal in these are taken equally often:
    as often as the one that is taken most. Null and blank texts have no words and are never taken; null doc_ids and
    sources are values like others; an empty table gives an empty one.
    """
    seed = options.get("seed", 17)
    taken = mix(docs, **options).filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("draw").alias("__draw"), "copies")
    taken = taken.groupBy("__id", "__source", "__draw").agg(F.max("copies").alias("__copies"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64(F.lit(seed), "doc_id", "text") == F.col("__draw"))
    times = F.transform(F.sequence(F.lit(1), F.col("__copies")), lambda i: i)
    return docs.join(taken, same).withColumn("__copy", F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    from foragelake.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
