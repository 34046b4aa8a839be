"""The Markov models of the secret scan: recall and precision on labelled strings they haven't seen, and plain counting."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from foragelake.llm import secrets as S

SF = "/root/testdata/sf0.01"
#: Ordinary names whose parts aren't those of the sample.
NAMES = """AbstractSingletonProxyFactoryBean HttpServletRequestWrapperImpl X509CertificateChainValidator internationalization
configuration_management_handler see/also/the/other/file/names under_the_water_of_the_river GetUserByEmailAddress2
REQUIRED_PARAMETER_MISSING /usr/local/lib/python3/dist-packages 4087441028983991 XMLHttpRequestEventTarget SHA256withRSAEncryption
JpegImageDecoderWindowsPhone UTF8StringBuilderFactory Donaudampfschifffahrtsgesellschaft aaaaaaaaaaaaaaaaaaaaaaaa
================================ pneumonoultramicroscopicsilicovolcanoconiosis thanonontioniner ERSCHSCHBERBERTZ""".split()
SECRETS = ["MIIEvQIBADANBgkqhkiG9w0BAQEFAASC", "xK9vQ2mZ7pL4wR8tY3bN6", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYq7Zt0d"]


@pytest.fixture(scope="module")
def models(spark):
    return S.train(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("name", sorted(S.RANDOM_ALPHABETS))
def test_recall_on_strings_not_seen(models, name):
    held = S.random_strings(2000, 4711, S.RANDOM_ALPHABETS[name])
    assert np.mean([models.is_secret(x) for x in held]) > 0.99


def test_precision_on_names_not_seen(models):
    # Samples of one half of the parts, held against a model of the other half.
    own = S.Models(models.ordinary.copy(), models.random)
    own.ordinary[1] = S.log_chances(S._sampled(S.ordinary_identifiers(S.SAMPLE, 3, S.PARTS[::2])))
    held = [x for x in S.ordinary_identifiers(4000, 5, S.PARTS[1::2]) if len(x) >= 16]
    assert np.mean([own.is_secret(x) for x in held]) < 0.002
    assert [x for x in NAMES if models.is_secret(x)] == []
    assert [x for x in SECRETS if not models.is_secret(x)] == []


def plain_counts(texts):
    ordinary, found = Counter(), Counter()
    for t in texts:
        code = [S.ALPHABET.find(c) if c in S.ALPHABET else S.N - 1 for c in t]
        out = {k for a, b in S.base_spans(t)[1] for k in range(a, b)} | {k for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t) for k in range(*m.span())}
        ordinary.update((code[k], code[k + 1]) for k in range(len(t) - 1) if not {k, k + 1} & out)
        for a, b in S.base_spans(t)[1]:
            found.update(zip(code[a:b], code[a + 1 : b], strict=False))
    return ordinary, found


def plain_chances(counts, prior=None):
    def chance(a, b):
        if not (S.ALPHABET[a].isalnum() and S.ALPHABET[b].isalnum()):
            return 0.0
        return math.log(0.95 * all_[a, b] / sums[a] + 0.05 / len(S.ALPHABET))

    each = range(S.N - 1)
    all_ = {(a, b): counts[a, b] + (prior[a, b] if prior else 1) for a in each for b in each}
    sums = {a: sum(all_[a, b] for b in each) for a in each}
    return [[chance(a, b) for b in each] for a in each]


def test_spans_against_plain_counting(spark):
    """Counts, probabilities and spans by loops over single characters; the method finds what the patterns don't."""
    rows = [
        (1, f"the ordinary words of a text {SECRETS[1]} and {NAMES[0]} end"),
        (2, 'secret = "0123456789abcdef01234567" then ' + SECRETS[2]),
        (3, None), (4, ""), (5, "short"), (5, "short"), (6, "=" * 40), (None, SECRETS[0]),
        (7, " ".join(NAMES)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.scan(docs).collect()}
    ordinary, found = plain_counts([t or "" for _, t in rows])
    kinds = {"o": [], "r": [plain_chances(found)]}
    for tokens, kind in ((S.ordinary_identifiers(S.SAMPLE, 7), "o"), (S.runs(), "o"), *((S.random_strings(S.SAMPLE // 4, 7 + i, a), "r") for i, a in enumerate(S.RANDOM_ALPHABETS.values()))):
        code = [[S.ALPHABET.index(c) for c in t] for t in tokens]
        pairs = Counter(p for x in code for p in zip(x, x[1:], strict=False))
        if kind == "o" and not kinds["o"]:
            names = {(a, b): pairs[a, b] + 1 for a in range(S.N - 1) for b in range(S.N - 1)}
            sums = {a: sum(names[a, b] for b in range(S.N - 1)) for a in range(S.N - 1)}
            kinds["o"].append(plain_chances(ordinary, {(a, b): 1000 * n / sums[a] for (a, b), n in names.items()}))
            pairs += Counter({k: 1 for k in names})
        kinds[kind].append(plain_chances(pairs))

    def ratio(token):
        code = [S.ALPHABET.index(c) for c in token]
        random, plain = (max(sum(m[a][b] for a, b in zip(code, code[1:], strict=False)) for m in kinds[k]) for k in "ro")
        return random - plain

    found_by_models = 0
    for doc_id, text in rows:
        tokens = [(m.start(), m.end(), ratio(m[0])) for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text or "")]
        spans = [(a, 3, b) for a, b, r in tokens if r >= 10 and r >= 0.35 * (b - a)]
        assert got[doc_id]["spans"] == S.joined(sorted(S.base_spans(text or "")[0] + spans))
        assert got[doc_id]["n_markov"] == len(spans)
        assert got[doc_id]["top_ratio"] == (pytest.approx(max(r / (b - a) for a, b, r in tokens)) if tokens else None)
        found_by_models += len(spans)
    assert found_by_models == 4 and got[1]["n_markov"] == 1 and got[7]["n_markov"] == 0


def test_the_models_find_the_secrets_of_the_corpus(spark):
    """The models are told nothing of the fixed patterns, so these are a second check of their recall."""
    rows = S.op7_secret_scan(spark, SF).collect()
    hexes = [r for r in rows if r["n_hex"]]
    assert hexes and sum(r["n_markov"] >= r["n_hex"] for r in hexes) >= 0.95 * len(hexes)
    assert sum(r["n_markov"] for r in rows if not r["n_hex"]) <= 0.01 * len(rows)
