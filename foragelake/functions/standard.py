"""URLs as browsers read and write them, as Column expressions.

`standard` gives the serialised form of any http(s) URL, or null for what isn't one. Nearly all URLs have that form already
but for letter case and dots; a pattern tells them, and only the others take the long way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nothing to strip, encode or compute: a name whose last label begins with a letter, a short port, characters that stay.
PLAIN = r"^(?i:https?)://(?:[A-Za-z0-9-]+\.)*[A-Za-z][A-Za-z0-9-]*(?::(?:0|[1-9]\d{0,3}))?(?:[/?#][\x21\x23-\x26\x28-\x3b\x3d\x3f-\x5b\x5d-\x5f\x61-\x7a\x7c\x7e]*)?\z"
PARTS = r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"

# ASCII that is percent-encoded in each part, beside controls, spaces and all that isn't ASCII.
IN_PATH, IN_QUERY, IN_FRAGMENT = "\"<>`{}", "\"<>'", "\"<>`"
IN_USER = "\"#<>?`{}/:;=@[\\]^|"
FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]"
# Fixed values of Punycode.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


# The long way is SQL text, made when this module is imported: built from Column objects anew for each use, it would take
# longer than most queries. Each function below gives the text of an expression of the texts that it is given.


def _let(value: str, name: str, body: str) -> str:
    """body, in which name stands for value."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _encoded(part: str, ascii_: str) -> str:
    """Runs of characters that stay, and runs that are written as the bytes they have in UTF-8."""
    kept = "".join(f"\\x{c:02x}" for c in range(0x21, 0x7F) if chr(c) not in ascii_)
    piece = f"CASE WHEN rlike(w, r'^[{kept}]') THEN w ELSE regexp_replace(hex(w), '(..)', '%$1') END"
    return f"array_join(transform(regexp_extract_all({part}, r'([{kept}]+|[^{kept}]+)', 1), w -> {piece}), '')"


def _adapted(delta: str, points: str, first: str) -> str:
    """The bias after a delta. A delta of a host is divided a few times at most until it is small."""
    d = f"CASE WHEN {first} THEN {delta} div {DAMP} ELSE {delta} div 2 END"
    start = f"transform(array({d}), d -> named_struct('d', d + d div {points}, 'k', 0L))[0]"
    step = f"CASE WHEN a.d > {(BASE - T_MIN) * T_MAX // 2} THEN named_struct('d', a.d div {BASE - T_MIN}, 'k', a.k + {BASE}L) ELSE a END"
    return f"aggregate(sequence(1, 7), {start}, (a, i) -> {step}, a -> a.k + ({BASE - T_MIN + 1} * a.d) div (a.d + {SKEW}))"


def _digits(delta: str, bias: str) -> str:
    """A delta as a number of variable length."""
    t = f"greatest({T_MIN}L, least({T_MAX}L, i * {BASE} - {bias}))"
    more = f"named_struct('q', (g.q - t) div ({BASE} - t), 'out', concat(g.out, substr('{DIGITS}', CAST(t + (g.q - t) % ({BASE} - t) + 1 AS INT), 1)), 'done', false)"
    last = f"named_struct('q', g.q, 'out', concat(g.out, substr('{DIGITS}', CAST(g.q + 1 AS INT), 1)), 'done', true)"
    step = f"CASE WHEN g.done THEN g ELSE {_let(t, 't', f'CASE WHEN g.q < t THEN {last} ELSE {more} END')} END"
    return f"aggregate(sequence(1, 12), named_struct('q', {delta}, 'out', '', 'done', false), (g, i) -> {step}, g -> g.out)"


def _punycode(label: str) -> str:
    """A label of a host with characters outside of ASCII, as ASCII.

    Those characters are inserted in the order of (code point, place). The delta of one is how far the insertion moves on:
    whole turns through the label for each code point skipped, and the characters passed in the last turn.
    """
    after = "named_struct('n', c.p, 'bias', {bias}, 'h', s.h + 1, 'b', s.b, 'at', v.place + 1, 'out', concat(s.out, {digits}))"
    after = after.format(bias=_adapted("v.delta", "(s.h + 1)", "s.h = s.b"), digits=_digits("v.delta", "s.bias"))
    moved = "named_struct('delta', place - s.at + (c.p - s.n) * (s.h + 1), 'place', place)"
    step = _let("CAST(size(filter(points, y -> y.i < c.i AND y.p <= c.p)) AS BIGINT)", "place", _let(moved, "v", after))
    basic = f"CAST(size(filter(points, y -> y.p < {FIRST})) AS BIGINT)"
    start = f"named_struct('n', {FIRST}L, 'bias', {BIAS}L, 'h', {basic}, 'b', {basic}, 'at', 0L, 'out', '')"
    rest = f"aggregate(array_sort(filter(points, y -> y.p >= {FIRST})), {start}, (s, c) -> {step}, s -> s.out)"
    kept = f"array_join(transform(filter(points, y -> y.p < {FIRST}), y -> chr(y.p)), '')"
    points = f"transform(split({label}, ''), (x, i) -> named_struct('p', CAST(conv(hex(encode(x, 'UTF-32')), 16, 10) AS BIGINT), 'i', CAST(i AS BIGINT)))"
    return _let(points, "points", _let(kept, "kept", f"concat('xn--', kept, CASE WHEN kept <> '' THEN '-' ELSE '' END, {rest})"))


def _number(part: str) -> str:
    """A part of an IPv4 address: hexadecimal, octal or decimal; null if it is no number."""
    sixteen = f"CASE WHEN length({part}) = 2 THEN 0L WHEN length({part}) <= 14 THEN CAST(conv(substr({part}, 3), 16, 10) AS BIGINT) ELSE {1 << 40}L END"
    eight = f"CASE WHEN length({part}) <= 15 THEN CAST(conv({part}, 8, 10) AS BIGINT) ELSE {1 << 40}L END"
    ten = f"coalesce(try_cast({part} AS BIGINT), {1 << 40}L)"
    return f"CASE WHEN rlike({part}, r'^0x[0-9a-f]*\\z') THEN {sixteen} WHEN rlike({part}, r'^0[0-7]*\\z') THEN {eight} WHEN rlike({part}, r'^[1-9][0-9]*\\z') THEN {ten} END"


def _address(name: str) -> str:
    """A host that ends in a number, as an IPv4 address; null if it isn't one."""
    parts = f"transform(split(regexp_replace({name}, r'\\.\\z', ''), r'\\.'), z -> {_number('z')})"
    front = "slice(n, 1, size(n) - 1)"
    good = f"size(n) <= 4 AND NOT exists(n, z -> z IS NULL) AND NOT exists({front}, z -> z > 255) AND element_at(n, -1) < shiftleft(1L, 8 * (5 - size(n)))"
    total = f"aggregate(transform({front}, (z, i) -> shiftleft(z, 8 * (3 - i))), element_at(n, -1), (e, z) -> e + z)"
    shown = "concat_ws('.', " + ", ".join(f"CAST(shiftright(t, {k}) & 255 AS STRING)" for k in (24, 16, 8, 0)) + ")"
    return _let(parts, "n", f"CASE WHEN {good} THEN {_let(total, 't', shown)} END")


def _host(raw: str) -> str:
    """A host in its written form; null if it can't be one. Letters are lower-cased, but not composed anew."""
    decoded = f"CASE WHEN contains({raw}, '%') THEN try_url_decode(replace({raw}, '+', '%2B')) ELSE {raw} END"
    wide = "".join(f"\\u{c:04x}" for c in (*range(0xFF01, 0xFF5F), 0x3002, 0xFF0E, 0xFF61, 0xAD, 0x200B, 0x2060))
    narrow = "".join(f"\\u{c - 0xFEE0:04x}" for c in range(0xFF01, 0xFF5F)) + "..."
    low = f"lower(translate({decoded}, '{wide}', '{narrow}'))"
    ascii_ = f"array_join(transform(split(h, r'\\.'), l -> CASE WHEN rlike(l, r'[^\\x00-\\x7f]') THEN {_punycode('l')} ELSE l END), '.')"
    named = f"CASE WHEN rlike(h, r'{FORBIDDEN}') OR h = '' THEN NULL WHEN rlike(h, r'(^|\\.)([0-9]+|0x[0-9a-f]*)\\.?\\z') THEN {_address('h')} ELSE {ascii_} END"
    return f"CASE WHEN rlike({raw}, r'(?i)^\\[[0-9a-f:.]+\\]\\z') THEN lower({raw}) ELSE {_let(low, 'h', named)} END"


def _serialised(raw: str) -> str:
    names = ("scheme", "authority", "path", "query", "fragment")
    parts = "named_struct(" + ", ".join(f"'{n}', regexp_extract(bare, r'{PARTS}', {i})" for i, n in enumerate(names, 1)) + ")"
    rest = r"regexp_extract(x.authority, r'(?s)^(?:.*@)?(.*)\z', 1)"
    host = _host(r"regexp_extract(rest, r'(?s)^(\[[^\]]*\]|[^:]*)(?::\d*)?\z', 1)")
    cut = rf"named_struct('user', regexp_extract(x.authority, r'(?s)^(.*)@', 1), 'host', {host}, 'port', regexp_replace(regexp_extract(rest, r':(\d*)\z', 1), '^0+(?=[0-9])', ''))"
    word = r"regexp_extract(o.user, r'(?s)^[^:]*:(.*)\z', 1)"
    shown = f"concat({_encoded("substring_index(o.user, ':', 1)", IN_USER)}, {_let(word, 'k', f"CASE WHEN k <> '' THEN concat(':', {_encoded('k', IN_USER)}) ELSE '' END")})"
    user = f"CASE WHEN o.user IN ('', ':') THEN '' ELSE concat({shown}, '@') END"
    path = _let(_encoded(r"replace(x.path, '\\', '/')", IN_PATH), "m", "CASE WHEN m = '' THEN '/' ELSE m END")
    whole = f"concat(lower(x.scheme), '://', {user}, o.host, CASE WHEN o.port = '' THEN '' ELSE concat(':', o.port) END, {path}, {_encoded('x.query', IN_QUERY)}, {_encoded('x.fragment', IN_FRAGMENT)})"
    made = f"CASE WHEN x.scheme <> '' AND (o.port = '' OR try_cast(o.port AS BIGINT) <= 65535) THEN {whole} END"
    bare = rf"regexp_replace(regexp_replace({raw}, r'^[\x00-\x20]+|[\x00-\x20]+\z', ''), r'[\t\n\r]', '')"
    return _let(bare, "bare", _let(parts, "x", _let(rest, "rest", _let(cut, "o", made))))


_LONG_WAY, _LABEL = (f"u -> {text}" for text in (_serialised("u"), _punycode("u")))


def _applied(text: str, c: Column) -> Column:
    return F.get(F.call_function("transform", F.array(c), F.expr(text)), F.lit(0))


def punycode(label: Column) -> Column:
    return _applied(_LABEL, label)


def standard(url: Column) -> Column:
    """A URL in the form that browsers give it, but for letter case of scheme and host and for dot segments of the path,
    which plain URLs may still have; null if it isn't an http(s) URL. Addresses of version 6 stay as they are written, and
    hosts aren't composed (NFC) before they are encoded."""
    return F.when(url.rlike(PLAIN), url).otherwise(_applied(_LONG_WAY, url))
