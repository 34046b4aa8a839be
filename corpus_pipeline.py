"""Corpus pipeline: quality filter, exact dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir), with docs the rows its predecessor kept, and is written before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foragelake.llm.common import materialize, table
from foragelake.llm.exact_dedup import deduplicate
from foragelake.llm.mixing import take_copies
from foragelake.llm.ngram_join import drop_near_duplicates
from foragelake.llm.packing import digest, pack
from foragelake.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (op 9); it is fitted on the labelled ones."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (op 4)."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, by five-word shingles and a similarity of 0.8, the row with the smallest doc_id stays (op 5)."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their weights (op 1); a document that the mix takes twice is there twice."""
    return take_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences (op 2); one row for each piece."""
    return digest(pack(docs))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixture), ("pack", packed)]

#: SQL can't express the classifier, so there is none for the rows of run(); tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir, each written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
