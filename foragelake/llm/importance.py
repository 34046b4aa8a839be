"""Importance resampling towards a target corpus, by inverted postings that are dealt by bucket.

1. Documents are read in blocks of a bounded number of postings. A block becomes one posting list for each bucket that it
   has: places of documents in the block, and how often they have a feature of the bucket.
2. Both corpora are counted by bucket, after each task has counted its own; what a bucket gains follows from its two
   counts and the two totals.
3. Posting lists are shuffled by bucket, where each meets its gain. The lists of a bucket are dealt to `salts` tasks by
   block, so that a bucket which nearly every document has isn't one task's; its gain goes to all of them.
4. The contributions, counts times gain, are shuffled by block and added up for each document.
5. The documents with the highest weight plus Gumbel noise are drawn, by a global range sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foragelake.llm.common import discard, materialize, table, text_or_empty
from foragelake.llm.sharding import number_rows

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Postings of a block, after which it ends; its documents at most, so that a place fits in 16 bits.
POSTINGS_EACH, DOCUMENTS_EACH = 1 << 20, 1 << 16
#: Parts of a bucket at least, and blocks for which there is one more.
SALTS, BLOCKS_EACH = 16, 64
#: Features of a task's words whose bucket is remembered.
_REMEMBERED = 1 << 17

#: A-Z as a-z; all of ASCII but 0-9 and a-z as a space.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def features(text: bytes, most: int) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of 1 to `most` of them."""
    words = text.translate(_FOLDED).split()
    out = list(words)
    for size in range(2, most + 1):
        out += [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len(words), out


_POSTED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("places", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("ids", "words", "features"))])
_POSTED_DDL = "block long, bucket int, places binary, counts binary, total long, ids array<long>, words array<long>, features array<long>"


def _narrow(counts: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _wide(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, f"<u{len(counts) // n}").astype(np.int64)


def _posted(buckets: int, most: int):
    """Blocks of documents: a row with bucket null, which has their ids and numbers of words and features, and a row per bucket."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        part, k = TaskContext.get().partitionId(), 0
        ids, words, sums, held, size = [], [], [], [], 0

        def bucket(feature: bytes) -> int:
            found = known.get(feature)
            if found is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                found = known[feature] = zlib.crc32(feature) % buckets
            return found

        def block() -> pa.RecordBatch:
            nonlocal ids, words, sums, held, size, k
            number = (part << 32) + k
            places = np.repeat(np.arange(len(held)), [len(b) for b, _ in held]).astype("<u2")
            b, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.argsort(b, kind="stable")
            b, n, places = b[order], n[order], places[order]
            starts = np.flatnonzero(np.diff(b, prepend=-1))
            ends = np.append(starts, len(b))[1:]
            empty = [None] * len(starts)
            cols = [
                [number] * (len(starts) + 1),
                [None, *b[starts].tolist()],
                [None, *(places[i:j].tobytes() for i, j in zip(starts, ends, strict=True))],
                [None, *(_narrow(n[i:j]) for i, j in zip(starts, ends, strict=True))],
                [None, *np.add.reduceat(n, starts).tolist()] if len(starts) else [None],
                [ids, *empty],
                [words, *empty],
                [sums, *empty],
            ]
            ids, words, sums, held, size, k = [], [], [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _POSTED, strict=True)], schema=_POSTED)

        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                n, found = features(text.as_py().encode("utf-8", "replace"), most)
                held.append(np.unique(np.fromiter(map(bucket, found), np.int64, len(found)), return_counts=True))
                ids.append(i)
                words.append(n)
                sums.append(len(found))
                size += len(held[-1][0])
                if size >= POSTINGS_EACH or len(ids) >= DOCUMENTS_EACH:
                    yield block()
        if ids:
            yield block()

    return post


def postings(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """block, bucket, places, counts, total (of counts), and in rows with bucket null ids, words, features: see _posted()."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_posted(buckets, most), _POSTED_DDL)


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of each bucket in postings of two corpora: at most `buckets` rows."""
    none = F.lit(0).cast("long")
    both = docs.select("bucket", F.col("total").alias("s"), none.alias("t")).unionByName(target.select("bucket", none.alias("s"), F.col("total").alias("t")))
    counted = both.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = counted.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(totals["S"] + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(totals["T"] + buckets)))
    return counted.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of a document; a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _added(lists: pa.Table, documents: pa.Table) -> pa.Table:
    """The weights of one block's documents: contributions of its posting lists, added up by place."""
    block, ids, words, sums = (documents[c][0].as_py() for c in ("of", "ids", "words", "features"))
    weight = np.zeros(len(ids), np.int64)
    for places, counts, gain in zip(lists["places"], lists["counts"], lists["gain"].to_pylist(), strict=True):
        at = np.frombuffer(places.as_py(), "<u2")
        # A list has each document once.
        weight[at] += _wide(counts.as_py(), len(at)) * gain
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "block": [block] * len(ids), "place": range(len(ids)), "n_words": words, "n_features": sums, "weight": weight})


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (from 1; null: not drawn), one row per document.

    A document's weight is the sum of the gains of its features, its score that plus the noise. Of the documents with
    `least_words` words or more, floor(percent / 100 of them) with the highest scores are drawn, ties to smaller doc_id,
    null first.

    Null and empty texts have no features: weight 0, never drawn. Rows that repeat doc_id and text are counted, weighed
    and ranked each, in any order among themselves. Rows of `target` (a column text) with null texts add nothing; with an
    empty target all gains come from what is rare in docs. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    posted = materialize(postings(docs, buckets, most), "postings")
    gain = gains(posted, postings(target.select(F.lit(0).alias("doc_id"), "text"), buckets, most), buckets)
    blocks = posted.filter("bucket IS NULL").select("block", "ids", "words", "features")
    salts = SALTS + blocks.count() // BLOCKS_EACH
    dealt = posted.filter("bucket IS NOT NULL").select("block", "bucket", "places", "counts", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    everywhere = gain.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    given = dealt.join(everywhere.hint("merge"), ["bucket", "salt"]).select("block", "places", "counts", "gain")
    whole = blocks.select(F.col("block").alias("of"), "ids", "words", "features")
    added = given.groupBy("block").cogroup(whole.groupBy("of")).applyInArrow(_added, "doc_id long, block long, place long, n_words long, n_features long, weight long")
    scored = materialize(added.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    eligible = scored.filter(F.col("n_words") >= least_words).withColumn("falling", -F.col("score"))
    drawn = (eligible.count() * percent) // 100
    ranked = number_rows(eligible, "falling", "doc_id", "block", "place").drop("falling")
    ranked = ranked.withColumn("rank", F.when(F.col("row_number") < drawn, F.col("row_number") + 1).cast("long")).drop("row_number")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    discard(posted)
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE crc(byte, value, k) AS (
    SELECT byte, byte, 0 FROM range(256) AS r(byte)
    UNION ALL
    SELECT byte, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END, k + 1 FROM crc WHERE k < 8
), crc_table AS (SELECT list(value ORDER BY byte) AS t FROM crc WHERE k = 8),
words_of AS (
    SELECT i, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM (SELECT row_number() OVER () AS i, 's' AS side, doc_id, text FROM documents
          UNION ALL SELECT row_number() OVER (), 't', NULL, text FROM benchmark)
), counted AS (SELECT side, i, word, count(*) AS n FROM (SELECT side, i, unnest(words) AS word FROM words_of) GROUP BY ALL
), hashed AS (
    SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(word)) + 1),
               lambda p: CAST('0x' || substr(hex(encode(word)), CAST(2 * p - 1 AS BIGINT), 2) AS BIGINT))),
               lambda c, x: xor(c // 256, t[CAST(xor(c, x) % 256 AS BIGINT) + 1]))) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM counted), crc_table
), by_bucket AS (
    SELECT bucket, CAST(sum(CASE WHEN side = 's' THEN n ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN side = 't' THEN n ELSE 0 END) AS DOUBLE) AS t
    FROM counted JOIN hashed USING (word) GROUP BY bucket
), gained AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((sum(s) OVER ()) + 10000) / ((s + 1) * ((sum(t) OVER ()) + 10000)))) AS BIGINT) AS gain FROM by_bucket
), weighed AS (
    SELECT i, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN hashed USING (word) JOIN gained USING (bucket) WHERE side = 's' GROUP BY i
), scored AS (
    SELECT i, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM words_of LEFT JOIN weighed USING (i) WHERE side = 's'
), placed AS (
    SELECT i, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= (10 * eligible) // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (i)
"""
