"""The opN queries against plain single-process versions, on whole small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foragelake.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts(docs):
    return {i: t or "" for i, t, _ in docs}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    from tests.test_queries import same_rows

    same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_op1(spark, docs):
    size = {i: len(SPACES.findall(t or "")) for i, t, _ in docs}
    total = Counter()
    for i, _, s in docs:
        total[s] += size[i]
    order = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), list(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * total[s]]
        if not above:
            break
        for s in above:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= share
    got = rows(spark, "op1_mix_sources")
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    source = {i: s for i, _, s in docs}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size.values()) + 1
    assert {(r["doc_id"], r["taken"]) for r in rows(spark, "op1_mix_sources")} == {(r["doc_id"], r["taken"]) for r in got}


def test_op2(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    got = rows(spark, "op2_pack")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at == len(ids[i])
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at <= 1024
    assert sum(map(len, ids.values())) / (1024 * len(by_seq)) > 0.98


def test_op3(spark, texts):
    same = {}
    for r in rows(spark, "op3_audio_features"):
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(payload) + 44
        assert same.setdefault(raw, (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"])
    assert len(set(same.values())) > 0.9 * len(same)


def components(texts: dict, width: int, percent: int) -> dict:
    sets, least = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = SPACES.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    order = sorted(texts)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    ra, rb = root(a), root(b)
                    least[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_op5(spark, texts):
    wanted = components(texts, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op5_ngram_join")} == wanted
    assert any(c != i for i, (_, c) in wanted.items())


def test_op6(spark, texts):
    got = rows(spark, "op6_shard")
    counts = defaultdict(list)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        counts[r["shard"]].append(r["slot"])
    assert sorted(counts) == list(range(40)) and sum(map(len, counts.values())) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["shard"]))] != sorted(texts)


def test_op7(spark):
    """On the larger tables: the smallest have no secret."""
    larger = SF.replace("sf0.001", "sf0.01")
    texts = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{larger}/documents.parquet'").fetchall()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = 0
    for r in QUERIES["op7_secret_scan"](spark, larger).collect():
        t = texts[r["doc_id"]]
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = Counter(k for _, k, _ in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds[0], kinds[1], kinds[2])
        assert r["base_sha256"] == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()
        assert {s for *_, s in spans} <= set(r["spans"].split(","))
        found += len(spans)
    assert found


def test_op9(spark, texts):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    right = n = 0
    for r in rows(spark, "op9_quality"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["held_out"] and labels.get(r["doc_id"]) is not None:
            right, n = right + (r["predicted"] == labels[r["doc_id"]]), n + 1
    assert n and right / n > 0.85


def test_op10(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    found = 0
    for r in rows(spark, "op10_license_scan"):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert r["n_words"] == len(words) and r["n_base"] == len(at)
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        found += len(at)
    assert found


def test_pipeline(spark, texts):
    """Each stage does its own work on what its predecessor kept; the last one packs every token of what is left."""
    import corpus_pipeline as P
    from foragelake.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        seen.append((name, docs, out))
        if name != "pack":
            assert out.columns == columns
        docs = out
    before, after = ({r["doc_id"]: r["text"] or "" for r in df.collect()} for df in seen[1][1:])
    assert {t: i for i, t in sorted(before.items())} == {t: i for i, t in after.items()}
    near = {r["doc_id"]: r["text"] or "" for r in seen[2][2].collect()}
    wanted = components(after, 5, 80)
    assert set(near) == {i for i, (_, c) in wanted.items() if c == i}
    mixed = Counter(r["doc_id"] for r in seen[3][2].collect())
    assert set(mixed) <= set(near) and set(mixed.values()) <= {1, 2}
    packed = Counter()
    for r in seen[4][2].collect():
        packed[r["doc_id"]] += r["length"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packed == {i: n * (len(tok.encode(near[i], add_special_tokens=False).ids) + 1) for i, n in mixed.items()}
