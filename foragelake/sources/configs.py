"""Configuration files: found and told apart, written by key, and runs of uses while they stay the same.

A store is a folder of snapshots, one for each batch of writes: a row per key with its document. A batch is applied to the
snapshot before it, so applying it again gives the same snapshot, and readers always see a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foragelake.functions.text import let

KINDS = ("presentation", "backends", "seen", "reset")
SNAPSHOT = "key string, body string, version long"


def file_status(body: Column) -> Column:
    """missing (null), malformed (no JSON, or null), legacy (settings at the root) or ok (they have a root of their own)."""

    def told(v: Column) -> Column:
        root = F.try_variant_get(v, "$.presentation", "variant").isNotNull()
        return F.when(body.isNull(), "missing").when(v.isNull() | F.is_variant_null(v), "malformed").when(root, "ok").otherwise("legacy")

    return let(F.try_parse_json(body), told)


def scan_configs(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key) -> key, body, status, for the files `<key>.json` below a folder; a key without a file is missing.
    Spark's file sources skip empty files, so an empty one is missing too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    found = files.select(F.regexp_extract("path", r"([^/]*)\.json\z", 1).alias("key"), F.decode("content", "UTF-8").alias("body"))
    return keys.select(F.col("key").cast("string").alias("key")).join(found, "key", "left").select("key", "body", file_status(F.col("body")).alias("status"))


def _members(body: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def apply_writes(files: DataFrame, writes: DataFrame) -> DataFrame:
    """files (key, body, version), writes (key, version, kind, body) -> the files after the writes.

    Of the writes of a kind the one with the highest (version, body) counts, so the order in which they come doesn't. A
    reset removes the file, and all writes of lower versions with it. `presentation` and `backends` replace what the file
    has under that name and keep everything beside it; the key of a fetch service is never stored. `seen` replaces the whole
    file by its body. A file that isn't JSON stays as it is, and writes to it are lost, until a reset. Writes of versions up to the file's own, or
    with a null key, are left out; a kept file has the highest version that was written to it.
    """
    kept = {k: F.max(F.when(F.col("kind") == k, F.struct("version", "body"))).alias(k) for k in KINDS[:3]}
    reset = F.max(F.when(F.col("kind") == "reset", F.col("version"))).over(Window.partitionBy("key"))
    old = files.select("key", F.col("body").alias("old"), F.col("version").alias("before"))
    new = writes.filter(F.col("key").isNotNull() & F.col("kind").isin(*KINDS)).join(old.select("key", "before"), "key", "left")
    new = new.filter(F.col("before").isNull() | (F.col("version") > F.col("before"))).withColumn("reset", reset)
    last = new.filter(F.col("reset").isNull() | (F.col("version") >= F.col("reset"))).groupBy("key").agg(F.max("version").alias("version"), F.max("reset").alias("reset"), *kept.values())
    rows = old.join(last, "key", "full")
    base = F.when(F.col("reset").isNull(), F.col("old"))
    broken = base.isNotNull() & file_status(base).isin("malformed")

    def document(members: Column) -> Column:
        out = members
        for name in KINDS[:2]:
            said = F.try_parse_json(F.col(name)["body"])
            if name == "backends":
                fetch = F.map_filter(F.try_variant_get(said, "$.fetch", "map<string,variant>"), lambda k, v: k != "apiKey")
                section = F.try_variant_get(said, "$", "map<string,variant>")
                said = F.try_parse_json(F.to_json(F.when(fetch.isNull(), section).otherwise(F.map_concat(F.map_filter(section, lambda k, v: k != "fetch"), F.create_map(F.lit("fetch"), F.try_parse_json(F.to_json(fetch)))))))
            put = F.map_concat(F.map_filter(out, lambda k, v: k != name), F.create_map(F.lit(name), said))  # noqa: B023
            out = F.when(F.col(name).isNotNull() & said.isNotNull(), put).otherwise(out)
        return F.to_json(out)

    wrote = F.col("presentation").isNotNull() | F.col("backends").isNotNull()
    seen = F.when(F.col("seen").isNotNull(), F.col("seen")["body"])
    body = F.when(broken, base).otherwise(F.coalesce(seen, F.when(wrote, document(_members(base))), base))
    return rows.select("key", body.alias("body"), F.coalesce("version", "before").alias("version")).filter("body IS NOT NULL")


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Batches whose snapshot is complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done if p.getName().startswith("batch="))


def read_store(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The files of the newest snapshot, or of the newest one of an earlier batch; none at first."""
    batches = [b for b in _snapshots(spark, path) if before is None or b < before]
    if not batches:
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(f"{path}/batch={batches[-1]}")


def commit_writes(path: str):
    """A function for foreachBatch: applies a batch of writes to the store. A batch that comes again gives the same snapshot."""

    def commit(writes: DataFrame, batch: int) -> None:
        spark = writes.sparkSession
        if batch not in _snapshots(spark, path):
            apply_writes(read_store(spark, path, before=batch), writes).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return commit


def unchanged_runs(log: DataFrame) -> DataFrame:
    """(session_id, pos, config: any value) -> session_id, run (from 0), first_pos, last_pos, uses.

    A use makes the tools anew when its configuration isn't that of the use before it; so a run is a series of uses, in the
    order of pos, whose configuration has one hash. Null configurations are alike.
    """
    by = Window.partitionBy("session_id").orderBy("pos")
    hashed = log.select("session_id", "pos", F.sha2(F.coalesce(F.to_json(F.struct("config")), F.lit("")), 256).alias("hash"))
    begins = ~F.col("hash").eqNullSafe(F.lag("hash").over(by))
    numbered = hashed.withColumn("begins", begins).withColumn("run", F.count_if("begins").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return numbered.groupBy("session_id", "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("uses"))
