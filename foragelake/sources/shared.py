"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it names none, a temporary one in local sessions, and an error elsewhere:
    executors of a cluster can't see the driver's local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='foragelake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows of a narrow table that one task holds.
ROWS = 50_000


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """df, shuffled by keys into tasks of about `rows` rows. Adaptive execution merges partitions by their compressed bytes,
    which say little about the memory of sorts and windows over narrow rows; a number that is given stays as it is."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def written(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """df, written to the shared folder and read back: later uses read it instead of computing it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*steps: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in steps:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
