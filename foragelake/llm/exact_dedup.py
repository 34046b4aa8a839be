"""Exact deduplication by skew-safe combining, with DataFrame functions only.

1. Each task combines its own equal texts (the partial side of an aggregation on digest and text).
2. Those winners meet under (digest, salt), so that a text with a third of all rows meets in `salts` tasks.
3. The salt winners, at most `salts` for a text, meet under the digest.

Every stage groups by the text itself next to the digest, so texts are compared in full and a digest that two texts
share can never merge them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foragelake.llm.common import materialize, table, text_or_empty

SALTS = 16


def _digested(docs: DataFrame, *more: str) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), *more)


def _combine(docs: DataFrame, best, salts: int) -> DataFrame:
    """digest, text, best (the greatest `best` of the group), group_size."""
    salted = (
        docs.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    # Dealt by the digest alone, so that the texts of a digest can also be counted without another shuffle.
    return salted.repartition("digest").groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))


def report(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; texts are compared as they are. Of equal texts the largest doc_id stays; a null
    doc_id stays only in a group without any other. Rows that repeat both doc_id and text are reported alike. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    digested = _digested(docs)
    groups = _combine(digested, F.col("doc_id"), salts)
    shared = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    groups = groups.withColumn("texts", shared).select("digest", F.when(F.col("texts") > 1, F.col("text")).alias("text"), F.col("best").alias("keep_id"), "group_size")
    groups = materialize(groups, "dedup-groups")
    # The text of a group is kept only where its digest stands for several texts. There are practically none.
    told = digested.select("doc_id", "digest").join(groups.filter("text IS NULL").drop("text"), "digest")
    clashing = groups.filter("text IS NOT NULL")
    if not clashing.isEmpty():
        told = told.unionByName(digested.join(clashing, ["digest", "text"]).drop("text"))
    return told.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest doc_id, with all its columns.

    Equal doc_ids are decided by the other columns, so exactly one row stays for each text. Null texts count as equal
    to empty ones. Columns may have any names; they must be of types that Spark can order.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("doc_id", F.struct(F.col("text").isNull().alias("blank"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"))
    text = text_or_empty()
    one = docs.select(text.alias("__text"), F.unhex(F.sha2(text, 256)).alias("__digest"), row.alias("__row"))
    groups = _combine(one.select(F.col("__digest").alias("digest"), F.col("__text").alias("text"), F.col("__row").alias("row")), F.col("row"), salts)
    kept = {"doc_id": F.col("best.doc_id"), "text": F.when(~F.col("best.rest.blank"), F.col("text"))} | {c: F.col(f"best.rest.c{i}") for i, c in enumerate(rest)}
    return groups.select(*[kept[c].alias(c) for c in docs.columns])


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
