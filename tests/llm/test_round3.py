"""Hard negatives, suffix-array repetition and importance resampling against plain versions, and their odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from foragelake.llm import importance, negatives, repetition
from foragelake.llm.queries import QUERIES
from tests.conftest import SF

# --- hard negatives -----------------------------------------------------------------------------------------------

VECTORS = "id long, label int, vector array<double>, score double, `block.x` string, part int, place int"


def plain_negatives(rows, anchors, positives, most, low, high):
    def sound(r):
        return None not in r[:3] and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in r[2])

    def score(a, b):
        return max(-(2**63) + 1, min(2**63 - 1, sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=False))))

    rows, out = [r for r in rows if sound(r)], []
    chosen = {}
    for a in (r for r in anchors if sound(r)):
        chosen[a[0]] = min(chosen.get(a[0], a), a, key=lambda r: (r[1], r[2]))
    for a in chosen.values():
        best = sorted((-score(a[2], r[2]), r[0], r[1]) for r in rows if r[0] != a[0])
        for s, p, _ in [b for b in best if b[2] == a[1]][:positives]:
            fits = [b for b in best if b[2] != a[1] and low * -s <= 100 * -b[0] <= high * -s][:most]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    made = [spark.createDataFrame([(*r, 1.0, "x", 2, 3) for r in x], VECTORS) for x in (rows, anchors)]
    return sorted(tuple(r)[:6] for r in negatives.hard_negatives(*made, **options).collect())


def test_negatives_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS_EACH", 7)
    monkeypatch.setattr(negatives, "ANCHORS_EACH", 4)
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.gauss(0.1, 1) for _ in range(4)]) for i in range(60)]
    rows += [rows[3], rows[3], rows[8], (9, 1, [0.5, 0.5, 0.5, 0.5])]
    rows += [(100, None, [1.0]), (101, 1, None), (102, 1, [1.0, None]), (103, 1, [float("nan")]), (104, 1, [float("inf")]), (None, 1, [1.0, 1.0])]
    rows += [(110, 0, []), (111, 1, [1.0]), (112, 2, [1.0, 1.0, 1.0, 1.0, 1.0]), (113, 1, [0.25] * 4), (114, 2, [0.25] * 4), (115, 0, [0.25] * 4)]
    anchors = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    want = plain_negatives(rows, anchors, 3, 4, 30, 90)
    assert len(want) > 50
    assert mined(spark, rows, anchors, positives=3, negatives=4) == want
    huge = [(i, i % 2, [rng.choice([1e9, 3e4, 1e160, -1e12]), rng.gauss(0, 1e9)]) for i in range(12)]
    assert mined(spark, huge, huge[:4]) == plain_negatives(huge, huge[:4], 5, 10, 30, 90)
    assert mined(spark, [], rows[:2]) == [] == mined(spark, rows[:9], [])


def test_ranked_is_the_same_by_both_ways():
    found = np.random.default_rng(3).integers(-5, 5, (20, 40))
    assert (negatives.ranked(found) == np.argsort(-found, axis=1, kind="stable")).all()
    assert (negatives.ranked(found << 58) == np.argsort(-found, axis=1, kind="stable")).all()


# --- repetition ---------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_longest(words):
    """For each word the longest run from it that also starts elsewhere."""
    n = len(words)
    out = [0] * n
    common = [[0] * (n + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            if i != j and words[i] == words[j]:
                common[i][j] = common[i + 1][j + 1] + 1
                out[i] = max(out[i], common[i][j])
    return out


def plain_rules(text, least=repetition.LEAST, part=repetition.MOST_COVERED, most=repetition.LONGEST):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += line in seen
            seen.add(line)
    longest = plain_longest(words)
    held = {i + k for i, n in enumerate(longest) if n >= least for k in range(n)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    kept = not failed and len(held) <= part * len(words) and max(longest, default=0) <= most
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(again), len(held), max(longest, default=0), failed, kept)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept")


def test_op12(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_quality_rules"](spark, SF).collect()}
    assert len(found) == len(docs)
    for i, text in docs:
        if len(WORDS.findall(text or "")) < 600:
            assert found[i] == plain_rules(text), i
    clean = duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()
    assert all(found[i][8] or found[i][7] for (i,) in clean)


def test_repeats_of_random_words():
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(70))) for _ in range(150)] + ["a " * 60, "", " "]
    longest, first = repetition.repeats([t.encode() for t in texts])
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert longest[a:b].tolist() == plain_longest(t.split())


def test_rules_odd_rows(spark):
    copied = " ".join(f"w{i}" for i in range(120))
    varied = " ".join(f"v{i}" for i in range(900))
    texts = [None, "", " \n\t", "\n\na b\n\na b\n a b\n", "naïve\x85word one \x1c # $ <p>", f"{copied} x {varied} y {copied}", varied, f"{varied} {copied[:-300]}", "the quick brown fox " * 30_000]
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts)] + [(None, varied, 1, "x", 2), (6, varied, 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `s.t` string, spans int")
    found = repetition.quality_rules(docs).collect()
    assert len(found) == len(rows)
    short = [r for r in found if r["doc_id"] != 8]
    text_of = dict(enumerate(texts)) | {None: varied}
    for r in short:
        assert tuple(r[c] for c in COLUMNS) == plain_rules(text_of[r["doc_id"]]), r["doc_id"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["covered_words"]
    (long_,) = (r for r in found if r["doc_id"] == 8)
    assert (long_["n_words"], long_["longest_repeat"], long_["covered_words"], long_["kept"]) == (120_000, 119_996, 120_000, False)
    by_id = {r["doc_id"]: r for r in short}
    assert by_id[5]["longest_repeat"] == 120 and not by_id[5]["kept"] and not by_id[5]["base_failed"]
    assert [tuple(s) for s in by_id[5]["spans"]] == [(0, 120), (1022, 1142)]
    assert by_id[6]["kept"]
    assert repetition.quality_rules(docs.limit(0)).collect() == []


# --- importance resampling ----------------------------------------------------------------------------------------


def plain_resample(docs, target, buckets=10_000, most=1, least=20, percent=10, seed=2024):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = word.findall((text or "").translate(fold))
        runs = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    ours, theirs = [(i, *features(t)) for i, t in docs], Counter()
    for t in target:
        theirs += features(t)[1]
    s = sum((c for _, _, c in ours), Counter())
    S, T = float(sum(s.values())), float(sum(theirs.values()))
    gain = {b: math.floor(1000 * math.log((theirs[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n, c in ours:
        weight = sum(k * gain[b] for b, k in c.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for r in out:
        r.append(None)
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resample(spark, monkeypatch, most):
    monkeypatch.setattr(importance, "_REMEMBERED", 50)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta", "GAMMA-7", "straße", "Ünï", "x"]) + rng.choice(["", ",", "1"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [docs[5], docs[5], (7, docs[9][1]), (None, docs[4][1]), (None, None), (130, None), (131, ""), (132, " .,"), (133, "hot " * 30_000)]
    target = ["alpha straße x", None, "", "beta " * 40]
    made = spark.createDataFrame([(*d, 1, "s", 2) for d in docs], "doc_id long, text string, bucket int, `a.b` string, rank int")
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    found = sorted(map(tuple, importance.resample(made, aim, buckets=97, most=most, percent=30).collect()), key=str)
    assert found == plain_resample(docs, target, buckets=97, most=most, percent=30)
    if most == 1:
        assert importance.resample(made.limit(0), aim).collect() == []
        none = sorted(map(tuple, importance.resample(made, aim.limit(0), percent=100).collect()), key=str)
        assert none == plain_resample(docs, [], percent=100)


def test_op13_at_default(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    want = [(r[0], *r[2:]) for r in plain_resample(docs, target)]
    assert sorted(map(tuple, QUERIES["op13_importance"](spark, SF).collect()), key=str) == sorted(want, key=str)
