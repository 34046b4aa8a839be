"""N-gram Jaccard join by vertical partitioning, and the groups that its links form.

Documents are sets of word n-grams. The n-grams have one global order, rare ones first, and that order is cut into
fragments. What two documents share is counted fragment by fragment, in separate tasks, and the partial counts are
summed for each pair, which then links when the Jaccard similarity reaches the threshold. Three things keep this exact
and linear in practice:

* Documents with equal sets are one class from the start, so copies never meet in pairs.
* A document can only link when enough of its n-grams occur in another class. Of the n-grams with the smallest hashes
  (one and a half times as many as a partner may lack) a partner shares at least a known number; documents that fall
  short are done, and for most corpora that is nearly all of them.
* Of the rest, two documents that link share an n-gram of their prefixes in the global order (rare n-grams, so the
  n-grams of a passage that many documents share don't count). First every document is compared with a centre: the
  document with the most common n-grams among those that share a few fixed ones with it. The links found make
  components; only pairs of different components are compared after that, and only those whose n-grams that other
  documents have could suffice. No link between components is lost, and a group of n near copies
  needs about n comparisons instead of n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foragelake.llm.common import discard, materialize, mix, shingles, table

#: Parts into which each frequency level of the order of n-grams is cut, for counting; a power of two.
FRAGMENTS = 2
#: N-grams by which a document looks for the centre of its group.
VOTES = 16
#: A list of chosen documents up to this length (about 50 MB) is broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 500_000
#: Rows of an n-gram in a block of the last search for pairs, and how often at most its rows are repeated for that.
BLOCK_ROWS, MOST_BLOCKS = 64, 32
#: An n-gram with more rows than those allow is searched in packed blocks of about so many rows, as many as it takes.
PACKED_ROWS = 2048
#: Bits of a hash that say in which cell it is counted, for bounds on what two documents share.
CELL_BITS = 6


def _bytes(texts: pd.Series) -> Iterator[bytes]:
    return ((t or "").encode("utf-8", "replace") for t in texts)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set of n-grams, as two signed numbers; zeros for the empty set."""
    out = []
    for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        place = np.arange(1, len(grams) + 1, dtype=np.uint64) * np.uint64(k)
        out.append(int(mix(mix(grams ^ place) + np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)))
    return out[0], out[1]


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, text_hash, high, low (digest of the set of n-grams), n_shingles, prefix (its smallest n-grams).

    Texts are cut into n-grams here; what is needed of all documents later is kept, so only texts of documents that may
    have a partner are read again.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*_digest(g), len(g), g[: _prefix(len(g), percent)].view(np.int64)) for g in shingles(_bytes(batch["text"]), width)]
            out = pd.DataFrame(found, columns=["high", "low", "n_shingles", "prefix"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "text_hash", batch["text_hash"].to_numpy())
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = rows.mapInPandas(sign, f"doc_id {kind}, text_hash long, high long, low long, n_shingles long, prefix array<long>")
    return signed.withColumn("row", F.monotonically_increasing_id())


def _lacks(n, percent: int):
    """How many of n n-grams a partner may lack: it shares at least percent/100 of them."""
    return n - -(-n * percent // 100)


def _least_shared(n, percent: int):
    """How many of the smallest `_lacks(n) * 3 // 2 + 1` n-grams, by any fixed order, a partner shares at least.

    Two sets that share o n-grams share at least l of their first |x| - o + l; the smaller one of a pair decides on l.
    """
    smallest = -(-n * percent // 100)
    return _lacks(smallest, percent) // 2 + 1


def _prefix(n: int, percent: int) -> int:
    return min(n, _lacks(n, percent) + _lacks(n, percent) // 2 + 1)


def _scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class, n, prefix) -> (gram, class, kind, n) of the smallest n-grams of every class in a batch.

    An n-gram that several classes of the batch share is settled here: the classes count it and only two of them are
    sent on as witnesses for other batches. So a passage in a third of all documents sends two rows for each batch.
    kind: -1 needs to be settled, -2 witness, otherwise the number of n-grams of the class that are settled.
    """
    for batch in batches:
        if not len(batch):
            continue
        classes, sizes = batch["class"].to_numpy(), np.array([len(p) for p in batch["prefix"]])
        grams = np.concatenate([np.asarray(p, np.int64) for p in batch["prefix"]])
        owner = np.repeat(np.arange(len(classes)), sizes)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        first = np.ones(len(grams), bool)
        first[1:] = grams[1:] != grams[:-1]
        run = np.cumsum(first) - 1
        shared = np.bincount(run)[run] > 1
        settled = np.bincount(owner[shared], minlength=len(classes))
        second = np.zeros(len(grams), bool)
        second[1:] = first[:-1]
        witness = shared & (first | second)
        for part, kind in ((~shared, -1), (witness, -2)):
            yield pd.DataFrame({"gram": grams[part], "class": classes[owner[part]], "kind": kind, "n": 0})
        yield pd.DataFrame({"gram": classes, "class": classes, "kind": settled, "n": batch["n"]})


def _survivors(classes: DataFrame, percent: int) -> DataFrame:
    """(class, n) of the classes that may have a partner.

    Of an n-gram, a window holds at most two rows for each batch of classes, however many documents have it.
    """
    rows = classes.select("class", "n", "prefix").mapInPandas(_scatter, "gram long, class long, kind int, n int")
    of = Window.partitionBy("gram")
    is_gram = F.col("kind") < 0
    several = F.min(F.when(is_gram, F.col("class"))).over(of) != F.max(F.when(is_gram, F.col("class"))).over(of)
    told = rows.withColumn("several", several).filter((F.col("kind") >= 0) | ((F.col("kind") == -1) & F.col("several")))
    counted = told.groupBy("class").agg(F.sum(F.when(is_gram, 1).otherwise(F.col("kind"))).alias("shared"), F.max("n").alias("n"))
    smallest = F.ceil(F.col("n") * percent / 100)
    needed = F.floor((smallest - F.ceil(smallest * percent / 100)) / 2) + 1
    return counted.filter(F.col("shared") >= needed).select("class", "n")


def _grams_of(docs: DataFrame, chosen: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """(class, n, gram) of the chosen documents (class, doc_id, text_hash, high, low), one for each class."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                # The digest tells a text of another document with the same id and hash.
                found = [(c, g) for c, high, low, g in zip(part["class"], part["high"], part["low"], shingles(_bytes(part["text"]), width), strict=True) if _digest(g) == (high, low)]
                sizes = np.array([len(g) for _, g in found], np.int64)
                classes = np.array([c for c, _ in found], np.int64)
                yield pd.DataFrame({"class": np.repeat(classes, sizes), "n": np.repeat(sizes, sizes), "gram": np.concatenate([g for _, g in found]).view(np.int64) if found else np.zeros(0, np.int64)})

    # Few documents are chosen as a rule: then their list goes to the texts, and only their texts are shuffled.
    few = chosen.count() <= broadcast_rows
    wanted = chosen.select("class", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"), "high", "low")
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.xxhash64("text") == F.col("wanted_hash"))
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, same).select("class", "high", "low", "text")
    # Rows that repeat id and text are one.
    once = texts.groupBy("class", "high", "low", F.sha2("text", 256).alias("sha")).agg(F.min("text").alias("text"))
    return once.select("class", "high", "low", "text").mapInPandas(cut, "class long, n long, gram long")


def _ordered(grams: DataFrame, percent: int) -> DataFrame:
    """(class, n, left, common, fragment, grams, prefix, votes): what a class has in each fragment of the order.

    The global order is by the power of two of an n-gram's frequency, then by its hash. An n-gram of one class only is
    in no overlap: it takes its place at the front of the prefix and is dropped; `left` n-grams of n remain. Votes are
    the VOTES n-grams with the smallest hashes of each class; `common` says how frequent the n-grams of a class are.
    """
    # Counted before the shuffle, and joined back to one row for each n-gram: a frequent one is split at run time.
    several = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("frequency")).filter(F.col("frequency") > 1)
    frequent = grams.join(several, "gram")
    by = Window.partitionBy("class")
    placed = frequent.select("class", "n", "gram", F.log2("frequency").alias("log"), F.floor(F.log2("frequency")).cast("int").alias("level"))
    placed = placed.withColumn("left", F.count(F.lit(1)).over(by)).withColumn("common", F.sum("log").over(by) / F.col("n"))
    placed = placed.withColumn("place", F.row_number().over(by.orderBy("level", "gram"))).withColumn("vote", F.row_number().over(by.orderBy("gram")) <= VOTES)
    # Consecutive parts of the order: the frequency level, and inside it a range of hashes.
    fragment = F.col("level") * FRAGMENTS + F.shiftrightunsigned("gram", 65 - FRAGMENTS.bit_length()).cast("int")
    prefix_size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("left"))
    placed = placed.withColumn("in_prefix", F.col("place") <= prefix_size).withColumn("fragment", fragment)
    chosen = {x: F.collect_list(F.when(F.col(y), F.col("gram"))).alias(x) for x, y in (("prefix", "in_prefix"), ("votes", "vote"))}
    return placed.groupBy("class", "n", "left", "common", "fragment").agg(F.collect_list("gram").alias("grams"), *chosen.values())


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _verified(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold: partial overlaps by fragment, summed for each pair."""
    left = fragments.select(F.col("class").alias("a"), "fragment", F.col("n").alias("na"), F.col("grams").alias("of_a"))
    right = fragments.select(F.col("class").alias("b"), "fragment", F.col("n").alias("nb"), F.col("grams").alias("of_b"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
    partial = partial.select("a", "b", "na", "nb", F.size(F.array_intersect("of_a", "of_b")).alias("both"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return summed.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether in edges (u, v), u > v, every u has one v, and no v is a u: then v is the smallest node reachable."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    ends = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return ends.filter("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def connected(links: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of links (a, b).

    Alternating large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows, until all components are stars; raises if that takes more than `rounds`. A hub meets its
    neighbours only in an aggregation and a join on one row for each node. No links give no rows.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), tag)
    for _ in range(rounds):
        if _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.filter("u <> v").distinct(), tag)
        discard(before)
    else:
        if not _are_stars(edges):
            raise RuntimeError(f"components aren't finished after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def class_components(docs: DataFrame, signed: DataFrame, ids: DataFrame, width: int, percent: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) of the classes that link with another class; signed: signatures(), ids: the classes of their digests."""
    own = signed.join(ids.select("class"), F.col("row") == F.col("class")).withColumnRenamed("n_shingles", "n")
    own = materialize(own.select("class", "n", "prefix", "doc_id", "text_hash", "high", "low"), "join-classes")
    chosen = materialize(own.drop("prefix", "n").join(_survivors(own, percent), "class"), "join-survivors")
    discard(own)
    grams = materialize(_grams_of(docs, chosen, width, broadcast_rows), "join-grams")
    ordered = materialize(_ordered(grams, percent), "join-fragments")
    discard(chosen, grams)
    votes = ordered.select("class", "n", "common", F.explode("votes").alias("gram"))
    prefixes = ordered.select("class", "n", "left", F.explode("prefix").alias("gram"))
    fragments = ordered.select("class", "fragment", "n", "grams")
    centres = votes.groupBy("gram").agg(F.max(F.struct("common", "class", "n")).alias("centre"))
    votes = votes.join(centres, "gram").filter(F.col("class") != F.col("centre.class"))
    votes = votes.filter(_similar_sizes(F.col("n"), F.col("centre.n"), percent)).select("class", F.col("centre.class").alias("centre"))
    votes = materialize(votes.groupBy("class", "centre").agg(F.count(F.lit(1)).alias("times")), "join-votes")
    links = None
    roots = None
    # The centre of most votes first; where that makes no link, the others too.
    for centres in (votes.groupBy("class").agg(F.max_by("centre", F.struct("times", "centre")).alias("centre")), votes):
        pairs = centres.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()
        if roots is not None:
            pairs = _apart(pairs, roots)
        found = _verified(pairs, fragments, percent)
        links = materialize(found if links is None else links.unionByName(found), "join-links")
        roots = materialize(connected(links), "join-roots")
    # What is left: pairs that share a prefix n-gram and whose components are still different.
    rooted = prefixes.join(roots, F.col("class") == F.col("node"), "left").select("gram", "class", "n", "left", F.coalesce("root", "class").alias("root"))
    rooted = materialize(rooted, "join-rooted")
    # The rows of a frequent n-gram meet in `blocks` squared blocks, each in a task of its own.
    count = F.count(F.lit(1))
    blocks = F.ceil(F.sqrt(count / BLOCK_ROWS)).cast("int")
    several = rooted.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks.alias("blocks"), F.ceil(count / PACKED_ROWS).cast("int").alias("packs"))
    several = several.filter("low <> high").select("gram", "blocks", "packs")
    mixed = materialize(rooted.join(several, "gram"), "join-mixed")
    discard(rooted)
    dealt = mixed
    whole = fragments.join(mixed.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    counted = whole.select("class", _cells("grams").alias("cells"))
    hot = _met_in_packs(mixed.filter(F.col("blocks") > MOST_BLOCKS).join(counted, "class"), percent)
    mixed = mixed.filter(F.col("blocks") <= MOST_BLOCKS)
    cells = counted.select("class", *[F.get("cells", F.lit(i)).alias(f"cell{i}") for i in range(1 << CELL_BITS)])
    mixed = mixed.join(cells, "class")
    own, each = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # A given number of partitions isn't merged at run time by size, which says little about the work here.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = mixed.withColumn("i", own).withColumn("j", each).repartition(n, "gram", "i", "j").alias("x")
    y = mixed.withColumn("j", own).withColumn("i", each).repartition(n, "gram", "i", "j").alias("y")
    meet = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.root") != F.col("y.root")) & _similar_sizes(F.col("x.n"), F.col("y.n"), percent)
    # No more can be shared than, in each cell of hashes, the one of fewer n-grams has there.
    most = sum((F.least(f"x.cell{i}", f"y.cell{i}") for i in range(1 << CELL_BITS)), F.lit(0))
    for bound in (F.least("x.left", "y.left"), most):
        meet = meet & (bound * 100 >= (F.col("x.n") + F.col("y.n") - bound) * percent)
    rest = x.join(y, meet).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).unionByName(hot).distinct()
    more = materialize(_verified(rest, fragments, percent), "join-links")
    discard(dealt, ordered, votes)
    if more.isEmpty():
        return roots
    return connected(links.unionByName(more))


_PACK = pa.schema([("gram", pa.int64()), ("pack", pa.int32()), ("packs", pa.int32()), *((c, pa.binary()) for c in ("class", "root", "n", "left", "cells"))])
_PACK_DDL = "gram long, pack int, packs int, class binary, root binary, n binary, left binary, cells binary"


def _packed(rows: pa.Table) -> pa.Table:
    """The rows of one pack of an n-gram as one row."""
    flat = {c: rows[c].to_numpy().astype("<i8").tobytes() for c in ("class", "root", "n", "left")}
    cells = rows["cells"].combine_chunks().flatten().to_numpy().astype("<i4").tobytes()
    return pa.Table.from_pylist([{c: rows[c][0].as_py() for c in ("gram", "pack", "packs")} | flat | {"cells": cells}], schema=_PACK)


def _candidates(percent: int):
    """Pairs of two packs that may link: other components, sizes, and what they can share by their cells."""

    def opened(pack: pa.Table) -> tuple[np.ndarray, ...]:
        row = pack.slice(0, 1).to_pylist()[0]
        return (*(np.frombuffer(row[c], "<i8") for c in ("class", "root", "n", "left")), np.frombuffer(row["cells"], "<i4").reshape(-1, 1 << CELL_BITS))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            # A pack to which no row was dealt isn't there.
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, ra, na, la, ca = opened(x)
        b, rb, nb, lb, cb = opened(y)
        of_a, of_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Cells added up by eights bound what is shared less closely, and decide on nearly all pairs.
        coarse_a, coarse_b = (c.reshape(len(c), -1, 8).sum(axis=2) for c in (ca, cb))
        for k in range(len(a)):
            fit = np.flatnonzero((rb != ra[k]) & (nb * 100 >= na[k] * percent) & (na[k] * 100 >= nb * percent) & (b != a[k]))
            for bound in (lambda f: np.minimum(lb[f], la[k]), lambda f: np.minimum(coarse_b[f], coarse_a[k]).sum(axis=1), lambda f: np.minimum(cb[f], ca[k]).sum(axis=1)):  # noqa: B023
                most = bound(fit)
                fit = fit[most * 100 >= (na[k] + nb[fit] - most) * percent]
            of_a.append(np.minimum(a[k], b[fit]))
            of_b.append(np.maximum(a[k], b[fit]))
        return pa.table({"a": np.concatenate(of_a), "b": np.concatenate(of_b)})

    return meet


def _met_in_packs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows (gram, class, root, n, left, cells, packs) of very frequent n-grams that may link.

    The rows of an n-gram are dealt to `packs` packs, and each pair of packs is a group of its own. So a group is as large
    as PACKED_ROWS says however frequent the n-gram is; more of them are needed, and they run wherever there is room.
    """
    packed = mixed.withColumn("pack", F.pmod(F.xxhash64("class"), F.col("packs")).cast("int"))
    packed = materialize(packed.groupBy("gram", "pack").applyInArrow(_packed, _PACK_DDL), "join-packs")
    x = packed.withColumn("i", F.col("pack")).withColumn("j", F.explode(F.sequence(F.col("pack"), F.col("packs") - 1)))
    y = packed.select(*[F.col(c).alias(f"y_{c}") for c in packed.columns]).withColumn("y_j", F.col("y_pack")).withColumn("y_i", F.explode(F.sequence(F.lit(0), F.col("y_pack"))))
    y = y.select(*[F.col(f"y_{c}").alias(c) for c in packed.columns if c not in ("gram", "pack", "packs")], "y_gram", "y_i", "y_j")
    met = x.groupBy("gram", "i", "j").cogroup(y.groupBy("y_gram", "y_i", "y_j"))
    return met.applyInArrow(_candidates(percent), "a long, b long")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cells(grams: pd.Series) -> pd.Series:
    """How many n-grams have each value of the first CELL_BITS bits of their hashes."""
    return pd.Series([np.bincount(np.asarray(g).view(np.uint64) >> np.uint64(64 - CELL_BITS), minlength=1 << CELL_BITS) for g in grams])


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(ra, "a", "left").join(rb, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents that a chain of links joins get the smallest doc_id among them.

    Two documents link when 100 * intersection >= percent * union of their distinct word n-grams (ASCII case doesn't
    count; with fewer than `width` words the whole sequence is the one n-gram). Null, empty and blank texts have no
    n-gram, link with nothing and are their own component; a null doc_id without partner has a null component. Rows
    that repeat a doc_id are told apart by their texts. An empty table gives an empty result; other columns are
    ignored, whatever their names. N-grams are compared by 64-bit hashes, sets by 128-bit digests.

    A class of copies may hold a third of all rows, and an n-gram be in a third of all documents. Both are aggregated
    before they are shuffled; where their rows are joined back, the other side has one row for each, and adaptive
    execution (spark.sql.adaptive.skewJoin, on by default) splits the large side.
    """
    return _told(docs, width, percent).select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _told(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The signatures with root (a class of the component) and component_id, both null for empty sets."""
    signed = materialize(signatures(docs, width, percent), "join-signatures")
    # A class is known by the number of its first row.
    ids = signed.filter("n_shingles > 0").groupBy("high", "low").agg(F.min("row").alias("class"), F.min("doc_id").alias("least"))
    ids = materialize(ids, "join-ids")
    roots = class_components(docs, signed, ids, width, percent)
    rooted = ids.join(roots, F.col("class") == F.col("node"), "left").select("high", "low", "least", F.coalesce("root", "class").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("high", "low", "root", "component_id")
    return signed.select("doc_id", "text_hash", "high", "low", "n_shingles").join(known, ["high", "low"], "left")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: exactly one of each component; texts without words all stay.

    It is the row with the smallest doc_id (null last), of these that with the smallest hash of its text, and of rows
    alike in both the first by all their columns. An empty table gives an empty one; columns keep names and order.
    """
    told = _told(docs, width, percent)
    alike = told.filter("n_shingles > 0").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"), (F.col("k.n") > 1).alias("__repeated"))
    bare = told.filter("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.lit(False).alias("__repeated"))
    stay = materialize(first.unionByName(bare.distinct()), "join-stay")
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    # Repeated keys are few; only their rows are dealt by key and ordered.
    by = Window.partitionBy("__id", "__hash").orderBy(F.to_json(F.struct(*names)))
    once = kept.filter("__repeated").withColumn("__at", F.row_number().over(by)).filter("__at = 1")
    return kept.filter("NOT __repeated").select(*names).unionByName(once.select(*names))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)
