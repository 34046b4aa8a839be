"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded, gated attention

    a_k  proportional to  exp(w . (tanh(V e_k) * sigmoid(U e_k)))

weighs the encodings e_k, and the weighted mean is scored by a logistic layer. Only documents have labels; the
attention learns which passages decide them. The model has a few thousand parameters and is fitted on a bounded sample
of labelled documents; scoring runs over all texts, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foragelake.llm.common import Words, blocks, table

PASSAGE = 64
THRESHOLD = 0.7
#: Bound of the fit: labelled documents, each with all its passages.
SAMPLE = 4000
FOLDS, HELD_OUT = 4, 2

_SIGNS = b"!#$%&*|.,:;-_=+/<>()[]{}@\"'?~^`\\"
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _c = bytes([_i])
    _CLASS[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c == b"\n" else 4 if _c.isspace() else 5 if _i > 127 else 6 + _SIGNS.index(_c) if _c in _SIGNS else 6 + len(_SIGNS)
CLASSES = int(_CLASS.max()) + 1
BUCKETS = 32
FEATURES = CLASSES + BUCKETS + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of some texts, and how many each text has; a text without words has one of zeros."""
    words = Words(texts)
    h = words.hashes()
    n_words = np.diff(words.first)
    n = np.maximum(1, -(-n_words // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    out = np.zeros((int(n.sum()), FEATURES), np.float32)
    if not len(h):
        return out, n
    doc = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(h)) - words.first[:-1][doc]
    of = first[doc] + place // PASSAGE
    m = len(out)
    count = np.bincount(of, minlength=m).astype(np.float32)
    safe = np.maximum(count, 1)

    # Each byte from the start of a passage's first word to the start of the next passage's counts for the passage.
    head = np.flatnonzero(place % PASSAGE == 0)
    edge = np.append(words.start[head], len(words.data))
    byte_of = np.repeat(of[head], np.diff(edge))
    classes = np.bincount(byte_of * CLASSES + _CLASS[words.data[edge[0] :]], minlength=m * CLASSES).reshape(m, CLASSES)
    out[:, :CLASSES] = classes / np.maximum(1, classes.sum(1, keepdims=True))
    bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    out[:, CLASSES : CLASSES + BUCKETS] = np.bincount(of * BUCKETS + bucket, minlength=m * BUCKETS).reshape(m, BUCKETS) / safe[:, None]

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, x, minlength=m) / safe

    length = (words.end - words.start).astype(np.float32)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    fresh = np.ones(len(h))
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    kind = _CLASS[words.data]
    out[:, -6] = np.log1p(count) / np.log1p(PASSAGE)
    out[:, -5] = mean(length) / 10
    out[:, -4] = np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10
    out[:, -3] = mean(again)
    out[:, -2] = np.bincount(of[order], fresh, minlength=m) / safe
    out[:, -1] = mean((kind[words.end - 1] == 1) & (length > 1))
    assert len(owner) == m
    return out, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Parameters of the classifier; with `constant` set, that score for every document."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(n), self.constant)
        return _forward(self.weights, (x - self.mean) / self.scale, n)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    at = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    e = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(e @ w["V"]), _sigmoid(e @ w["U"])
    r = (t * s) @ w["w"]
    r = np.exp(r - np.maximum.reduceat(r, at)[of])
    a = r / np.add.reduceat(r, at)[of]
    z = np.add.reduceat(a[:, None] * e, at)
    return {"at": at, "of": of, "e": e, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["c0"])}


def fit(x: np.ndarray, n: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    """Fits the model by Adam. Without both labels in y, the model gives every document the mean label (1 without any)."""
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1), np.ones(1), {}, float(y.mean()) if len(y) else 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    w = {
        "W": rng.normal(0, 0.2, (x.shape[1], hidden)),
        "b": np.zeros(hidden),
        "V": rng.normal(0, 0.3, (hidden, gate)),
        "U": rng.normal(0, 0.3, (hidden, gate)),
        "w": np.zeros(gate),
        "c": rng.normal(0, 0.3, hidden),
        "c0": np.zeros(1),
    }
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    at = np.cumsum(n) - n
    step = 0
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs) + rate / 50
        order = rng.permutation(len(n))
        for lo in range(0, len(n), batch):
            rows = order[lo : lo + batch]
            part = np.concatenate([np.arange(at[i], at[i] + n[i]) for i in rows])
            grad = _gradient(w, x[part], n[rows], y[rows])
            step += 1
            for k, g in grad.items():
                g = g + decay * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                w[k] = w[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, n)
    at, of, e, t, s, a = (f[k] for k in ("at", "of", "e", "t", "s", "a"))
    d = (f["p"] - y) / len(y)
    dz = (d[:, None] * w["c"])[of]
    da = (dz * e).sum(1)
    dr = a * (da - np.add.reduceat(a * da, at)[of])
    dg = dr[:, None] * w["w"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    de = a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T
    dx = de * (1 - e * e)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": e.T @ dt, "U": e.T @ ds, "w": (t * s).T @ dr, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo FOLDS; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(0))


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        at = 0
        for block in blocks((t or "").encode("utf-8", "replace") for t in batch["text"]):
            x, n = passages(block)
            ends = np.cumsum(n)
            part = batch.iloc[at : at + len(block)]
            yield pd.DataFrame({"quality": part["quality"], "draw": part["draw"], "bag": [x[b - k : b].tobytes() for b, k in zip(ends, n, strict=True)]})
            at += len(block)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents outside the held-out fold, drawn by a hash of their doc_id."""
    chosen = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & (fold() != HELD_OUT) & F.col("doc_id").isNotNull())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # At most `sample` pairs of two numbers: small whatever the corpus.
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text", F.xxhash64("doc_id", "text").alias("draw"))
    # Passages are encoded where the texts are; only their features are put in order and gathered.
    rows = bags.mapInPandas(_bags, "quality int, draw long, bag binary").orderBy("draw", "quality", "bag").limit(sample).collect()
    rows.sort(key=lambda r: (bytes(r["bag"]), r["quality"]))
    bags_ = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    y = np.array([r["quality"] for r in rows], float)
    return fit(np.concatenate(bags_) if bags_ else np.zeros((0, FEATURES)), np.array([len(b) for b in bags_], int), y)


def scorer(model: Model):
    """A column function text -> score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [model.score(*passages(block)) for block in blocks((t or "").encode("utf-8", "replace") for t in texts)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document.

    The score is of the text alone. Null and empty texts are one passage without words and are scored as such.
    Repeated rows repeat their result; an empty table gives an empty result. With labels of one kind only, every score
    is their mean; without labels it is 1. Other columns are ignored, whatever their names.
    """
    score = scorer(train(docs, labels))
    scored = docs.select("doc_id", (fold() == HELD_OUT).alias("held_out"), score("text").alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text scores THRESHOLD or more, with all their columns; fitted on the labelled ones.

    As classify() scores: a null or empty text is one passage without words. Repeated rows stay or go alike, labels of
    documents that aren't there count for nothing, and an empty table gives an empty one.
    """
    return docs.filter(scorer(train(docs, labels))(F.col("text")) >= THRESHOLD)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
