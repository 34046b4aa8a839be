"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two kinds of strings have first-order character models, trained from labelled samples: ordinary identifiers (the
words of the corpus that are too short to be judged and in no value that the fixed patterns find; words joined as
programs and paths do; runs of one sign) and random strings (those values; and strings drawn over the usual alphabets). A kind is as likely as its
likeliest model makes it. A token is reported when the log-likelihood ratio of the two kinds, for the whole token and for
each character, is high enough. Tokens are judged whether or not a fixed pattern finds them too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foragelake.llm.common import table

# The patterns of the base kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6

#: What a token that the models judge consists of, and how long it is at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Natural-log likelihood ratio that a token needs in all and for each character.
LEAST_RATIO = 10.0
LEAST_RATIO_PER_CHAR = 0.35
#: Labelled tokens of each kind that are drawn, beside those of the corpus.
SAMPLE = 20_000
#: Share of any character at all in each model.
ANY_SHARE = 0.05
#: How many pairs of the drawn names the model of the corpus begins with, for each character.
PRIOR = 1000.0

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
N = len(ALPHABET) + 1
_CODE = np.full(256, N - 1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))

#: Alphabets over which random strings are drawn.
RANDOM_ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": ALPHABET[:62], "base64": ALPHABET[:64]}
#: Words of which ordinary identifiers are made.
PARTS = (
    "abstract", "access", "account", "action", "adapter", "address", "admin", "after", "agent", "alias", "amount", "apache", "application", "archive", "array", "async",
    "attribute", "audio", "author", "auto", "backup", "base", "batch", "bean", "before", "binary", "block", "body", "boolean", "bridge", "buffer", "build", "builder", "bundle",
    "button", "byte", "cache", "callback", "cancel", "certificate", "chain", "channel", "char", "check", "child", "class", "clean", "client", "cloud", "cluster", "code", "collection",
    "column", "command", "common", "compare", "component", "config", "configuration", "connect", "connection", "console", "constant", "container", "content", "context", "control",
    "controller", "convert", "cookie", "core", "count", "create", "current", "cursor", "custom", "data", "database", "date", "debug", "decode", "default", "delete", "detail",
    "device", "dialog", "directory", "disable", "dispatch", "display", "document", "domain", "driver", "edit", "element", "email", "enable", "encode", "engine", "entity", "entry",
    "enum", "error", "event", "example", "exception", "execute", "export", "extension", "factory", "feature", "field", "file", "filter", "final", "find", "first", "float", "folder",
    "format", "frame", "from", "function", "generate", "generic", "global", "graph", "group", "handler", "hash", "header", "height", "helper", "history", "home", "host", "html",
    "http", "icon", "image", "impl", "import", "index", "info", "init", "input", "insert", "instance", "integer", "interface", "internal", "item", "iterator", "java", "job", "json",
    "kernel", "label", "language", "last", "layer", "layout", "length", "level", "library", "limit", "line", "link", "list", "listener", "load", "local", "location", "lock",
    "logger", "login", "machine", "main", "manager", "mapper", "mask", "master", "match", "matrix", "media", "member", "memory", "menu", "merge", "message", "meta", "method", "model",
    "module", "monitor", "mouse", "name", "network", "node", "notification", "number", "object", "offset", "open", "option", "order", "output", "owner", "package", "page",
    "panel", "parameter", "parent", "parse", "parser", "path", "pattern", "payment", "pixel", "player", "plugin", "point", "policy", "pool", "port", "position", "prefix", "print",
    "process", "product", "profile", "progress", "project", "property", "protocol", "provider", "proxy", "public", "query", "queue", "random", "range", "read", "record", "region",
    "register", "remote", "remove", "render", "report", "request", "reset", "resource", "response", "result", "role", "root", "route", "router", "rule", "sample", "scale", "schedule",
    "schema", "scope", "screen", "script", "search", "section", "select", "sender", "sequence", "serial", "server", "service", "servlet", "session", "setting", "shader", "shape",
    "share", "signature", "simple", "single", "size", "socket", "sort", "source", "space", "split", "stack", "start", "state", "static", "status", "step", "storage", "store", "stream",
    "string", "strategy", "style", "submit", "support", "switch", "symbol", "sync", "system", "table", "target", "task", "template", "test", "text", "thread", "throw", "time", "title",
    "tool", "trace", "track", "transaction", "transform", "tree", "trigger", "type", "unit", "update", "upload", "user", "util", "utils", "valid", "validator", "value", "variable",
    "vector", "version", "video", "view", "virtual", "visible", "wait", "watch", "width", "window", "worker", "wrapper", "write", "writer", "xml", "yaml", "zone",
)

Span = tuple[int, int, int]

_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")


def _marks(characters: str) -> bytes:
    return bytes(120 if chr(i) in characters else 32 for i in range(256))


_HEX_MARKS, _CANDIDATE_MARKS = _marks("0123456789abcdef"), _marks(ALPHABET.replace(".", ""))


def _has_run(text: str, marks: bytes, length: int) -> bool:
    """Whether so many of the marked ASCII characters stand together: far cheaper than a search by pattern."""
    return b"x" * length in text.encode("utf-8", "replace").translate(marks)


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """(start, kind number, end) of the base kinds by start and kind; and where their random values stand."""
    spans: list[Span] = []
    values: list[tuple[int, int]] = []
    low = text.lower()
    for m in ASSIGN.finditer(text) if any(k in low for k in _KEYWORDS) else ():
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            spans.append((m.start(), 0, m.end()))
            values.append(m.span(2))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text) if kind == 1 or _has_run(text, _HEX_MARKS, 24) else ():
            spans.append((m.start(), kind, m.end()))
            values.append(m.span())
    spans.sort()
    return spans, values


# --- labelled samples ---------------------------------------------------------------------------------------------


def random_strings(n: int, seed: int, alphabet: str) -> list[str]:
    """Strings labelled random: 16 to 63 characters, drawn evenly from an alphabet."""
    rng = np.random.default_rng(seed)
    letters = np.array(list(alphabet))
    return ["".join(letters[rng.integers(0, len(letters), k)]) for k in rng.integers(16, 64, n)]


def ordinary_identifiers(n: int, seed: int, parts: tuple[str, ...] = PARTS) -> list[str]:
    """Strings labelled ordinary: parts joined as programs and paths do, with short numbers in some; and long numbers."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = [parts[i] for i in rng.integers(0, len(parts), rng.integers(2, 6))]
        # Many names hold a short number, such as X509 or utf8.
        if rng.random() < 0.3:
            words[rng.integers(0, len(words))] += str(rng.integers(0, 10 ** int(rng.integers(1, 5))))
        form = rng.integers(0, 8)
        if form <= 2:
            name = "".join(w.capitalize() for w in words)
            out.append(name[0].lower() + name[1:] if form == 0 else name)
        elif form <= 5:
            out.append(("_", "-", "/")[form - 3].join(words))
        elif form == 6:
            out.append("_".join(words).upper())
        else:
            out.append("".join(map(str, rng.integers(0, 10, rng.integers(8, 24)))))
    return out


def runs(length: int = 256) -> list[str]:
    """Strings labelled ordinary: each sign repeated, as in rules, fillers and placeholders."""
    return [sign * length for sign in ALPHABET]


# --- the models ---------------------------------------------------------------------------------------------------


def _pairs(text: str) -> np.ndarray:
    """Counts of character pairs, those with any other character in the last row and column."""
    code = _CODE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    return np.bincount(code[:-1] * N + code[1:], minlength=N * N) if len(code) > 1 else np.zeros(N * N, np.int64)


def ordinary_part(text: str, values: list[tuple[int, int]]) -> str:
    """A text without the values of the fixed patterns and without tokens long enough to be judged."""
    tokens = [m.span() for m in CANDIDATE.finditer(text)] if _has_run(text, _CANDIDATE_MARKS, 16) else []
    parts, at = [], 0
    for a, b in sorted(values + tokens):
        parts.append(text[at : max(a, at)])
        at = max(at, b)
    return "\n".join([*parts, text[at:]])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, N * N), np.int64)
    for batch in batches:
        for text in batch["text"]:
            if text:
                _, values = base_spans(text)
                counts[0] += _pairs(ordinary_part(text, values))
                for a, b in values:
                    counts[1] += _pairs(text[a:b])
    label, pair = np.nonzero(counts)
    yield pd.DataFrame({"label": label.astype(np.int32), "pair": pair.astype(np.int32), "n": counts[label, pair]})


def log_chances(counts: np.ndarray, prior: np.ndarray | float = 1.0, any_share: float = ANY_SHARE) -> np.ndarray:
    """Log-probability of each character after each other one, from counts of pairs; separators aren't judged.

    `prior` counts are added; and a share of each probability is that of any character at all, for pairs that a sample
    lacks. Separators stand in paths and identifiers as well as in encoded strings: pairs with them are equally likely in all
    models.
    """
    inside = (counts.reshape(N, N)[:-1, :-1] if counts.size == N * N else counts) + prior
    out = np.log((1 - any_share) * inside / inside.sum(1, keepdims=True) + any_share / len(ALPHABET))
    signs = [not c.isalnum() for c in ALPHABET]
    out[signs, :] = 0
    out[:, signs] = 0
    return out


@dataclass(frozen=True)
class Models:
    """Log-probabilities (model x character x next character) of ordinary and of random strings."""

    ordinary: np.ndarray
    random: np.ndarray

    def ratio(self, token: str) -> float:
        code = _CODE[np.frombuffer(token.encode(), np.uint8)]
        a, b = code[:-1], code[1:]
        return float(self.random[:, a, b].sum(1).max() - self.ordinary[:, a, b].sum(1).max())

    def is_secret(self, token: str) -> bool:
        ratio = self.ratio(token)
        return ratio >= LEAST_RATIO and ratio >= LEAST_RATIO_PER_CHAR * len(token)


def _sampled(tokens: list[str]) -> np.ndarray:
    return _pairs("\n".join(tokens))


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Models:
    """Models of both kinds: one of the corpus (every pair of every document) and one for each drawn sample.

    Only sums come back from the documents: one for each label and pair of the alphabet.
    """
    rows = docs.select("text").mapInPandas(_count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    corpus = np.zeros((2, N * N), np.int64)
    for r in rows:
        corpus[r["label"], r["pair"]] = r["n"]
    drawn = [random_strings(sample // len(RANDOM_ALPHABETS), seed + i, a) for i, a in enumerate(RANDOM_ALPHABETS.values())]
    # Without values found in it, the corpus says nothing about random strings.
    random = [_sampled(d) for d in drawn] + ([corpus[1]] if corpus[1].any() else [])
    names = _sampled(ordinary_identifiers(sample, seed)).reshape(N, N)[:-1, :-1] + 1.0
    # A small corpus says little about ordinary words either: it begins with what the names say.
    ordinary = [log_chances(corpus[0], PRIOR * names / names.sum(1, keepdims=True)), log_chances(names), log_chances(_sampled(runs()))]
    return Models(np.stack(ordinary), np.stack([log_chances(c) for c in random]))


def markov_spans(text: str, models: Models) -> tuple[list[Span], float | None]:
    """Tokens that the models report, and the highest ratio for each character of any token (null without tokens)."""
    out: list[Span] = []
    highest = None
    for m in CANDIDATE.finditer(text) if _has_run(text, _CANDIDATE_MARKS, 16) else ():
        a, b = m.span()
        ratio = models.ratio(m[0])
        if ratio >= LEAST_RATIO and ratio >= LEAST_RATIO_PER_CHAR * (b - a):
            out.append((a, 3, b))
        highest = max(highest, ratio / (b - a)) if highest is not None else ratio / (b - a)
    return out, highest


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans (kind:start:end, comma-joined), top_ratio.

    Spans are in code points, by start and kind; spans of unlike kinds may overlap, and a secret that a fixed pattern and
    the models find has a span of each. top_ratio is the highest log-likelihood ratio for each character of any token of
    16 characters or more, null where there is none. Null and empty texts have no span. Every row is scanned by itself
    and whole, so repeated rows repeat their result and an empty table gives an empty one. Other columns are ignored,
    whatever their names.
    """
    if models is None:
        models = train(docs)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                text = text or ""
                base, _ = base_spans(text)
                more, highest = markov_spans(text, models)
                kinds = [k for _, k, _ in base]
                found.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), highest))
            out = pd.DataFrame(found, columns=["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "top_ratio"]).astype({"top_ratio": "float64"})
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(find, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, top_ratio double")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
