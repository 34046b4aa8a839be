"""Recorded answers of services: JSON lines below a folder for each provider, as a batch and as a stream.

They are read by Spark's own file source, so the folder may be in any store that Spark reads. A filter on the provider
prunes folders before anything is opened, every file is a task of its own, and a stream keeps its offsets (the files it has
read) in its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIELDS = "request_id long, http_status int, body string, failure string"


def record(responses: DataFrame, path: str) -> None:
    """Adds answers (request_id, provider, http_status, body, failure) to the folder."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    responses.select("provider", *names).write.partitionBy("provider").mode("append").json(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers. A broken line gives a row whose answer is null, which counts as none."""
    return spark.read.schema(f"{FIELDS}, provider string").json(path)


def recorded_stream(spark: SparkSession, path: str, files_each: int = 64) -> DataFrame:
    """The same as a stream, with at most files_each files in a micro-batch."""
    return spark.readStream.schema(f"{FIELDS}, provider string").option("maxFilesPerTrigger", files_each).json(path)
