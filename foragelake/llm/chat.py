"""Chat formatting with schema fingerprints, with DataFrame functions only.

Records come in unlike layouts, as JSON text or as typed columns of which each row fills its own. The nested field paths
that a record has are hashed; the hash selects one declarative mapping of `LAYOUTS`, which says where the turns are and
what they are called. The canonical turns are written with a reversible template, and `read_back` recovers them from the
formatted text.

    <|turn:user|>text<|end|>\\n

Inside a text a backslash is doubled and `<|` becomes `<\\|`, so no text can hold a mark; roles are percent-encoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from foragelake.llm.common import table

#: From this length on the JSON parser refuses a string.
PARSER_LIMIT = 20_000_000
OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>\n"
TURN = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How one record layout becomes turns.

    Either `items` is the path of an array whose elements have `role` and `text` fields (and `roles` renames roles), or
    `fields` lists (role, paths): a turn for each entry whose paths hold text, joined by a blank line. `lead` lists
    (role, path) of texts beside an array that come before its turns, unless a turn of that role has the same text.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    lead: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> tuple[str, ...]:
        if self.items:
            return (*(f"{self.items}[*].{x}" for x in (self.role, self.text)), *(p for _, p in self.lead))
        return tuple(p for _, paths in self.fields for p in paths)


_LEAD = {"lead": (("system", "system"), ("user", "prompt")), "optional": ("system", "prompt")}
#: In order of precedence: of layouts that a record's paths fit, the first one is taken.
LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content", turn="turn", **_LEAD),
    Layout("rows", items="turns", role="role", text="text", turn="turn", **_LEAD),
    Layout("sharegpt", items="conversations", role="from", text="value", turn="turn", roles=(("human", "user"), ("gpt", "assistant")), **_LEAD),
    Layout("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("question", fields=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
)


def _known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths()})


@dataclass(frozen=True)
class Access:
    """How a record is read: the array that a layout's turns are in, a value of one of its elements or of the record, and
    whether there is one."""

    items: Callable[[str], Column]
    value: Callable[[Column | None, str, str], Column]
    has: Callable[[Column | None, str], Column]


#: Access to records, by the path of the array that is read ("" for none).
Source = Callable[[str], Access]


def variant_source(record: Column) -> Source:
    """Records as variants; fields of other types than asked for are null."""

    def at(v: Column | None) -> Column:
        return record if v is None else v

    read = Access(
        lambda path: F.try_variant_get(record, f"$.{path}", "array<variant>"),
        lambda v, name, kind: F.try_variant_get(at(v), f"$.{name}", kind),
        lambda v, name: F.variant_get(at(v), f"$.{name}", "variant").isNotNull(),
    )
    return lambda items: read


def typed_source(schema: StructType) -> Source:
    """Records whose fields are columns; a field that the schema or the row doesn't have is null. No text passes a parser."""

    def of(items: str) -> Access:
        array = schema[items].dataType if items in schema.names else None
        inner = array.elementType.names if isinstance(array, ArrayType) and isinstance(array.elementType, StructType) else []
        none = F.array().cast("array<struct<_:int>>") if not inner else None

        def value(v: Column | None, name: str, kind: str) -> Column:
            if name not in (schema.names if v is None else inner):
                return F.lit(None).cast(kind)
            return (F.col(name) if v is None else v[name]).cast(kind)

        def has(v: Column | None, name: str) -> Column:
            return value(v, name, "string").isNotNull()

        return Access(lambda path: F.col(path) if none is None else none, value, has)

    return of


def _present(source: Source, path: str) -> Column:
    """Whether a record has a path, in any element where it goes through an array."""
    if "[*]." not in path:
        return source("").has(None, path)
    items, name = path.split("[*].")
    read = source(items)
    return F.coalesce(F.exists(read.items(items), lambda v: read.has(v, name)), F.lit(False))


def fingerprint(source: Source, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the nested field paths, of all that any mapping reads, which a record has; others don't count."""
    present = F.array_compact(F.array(*[F.when(_present(source, p), F.lit(p)) for p in _known_paths(layouts)]))
    return F.md5(F.array_join(present, "\n"))


def _mappings(layouts: tuple[Layout, ...]) -> list[tuple[tuple[str, ...], Layout]]:
    """The sets of paths that select a layout; computed from the declarations."""
    out = []
    for x in layouts:
        sets = [()]
        for p in x.paths():
            sets = [(*s, p) for s in sets] + (sets if p in x.optional else [])
        out += [(tuple(sorted(s)), x) for s in sets]
    return out


def canonical_turns(source: Source, found: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Array of (turn, role, text) of a record with the fingerprint `found`; null when no mapping has that fingerprint."""
    keys: dict[str, Layout] = {}
    for paths, x in _mappings(layouts):
        keys.setdefault(hashlib.md5("\n".join(paths).encode(), usedforsecurity=False).hexdigest(), x)
    turns = None
    for x in layouts:
        chosen = found.isin(*[k for k, y in keys.items() if y is x])
        mapped = _turns(source(x.items), x)
        turns = F.when(chosen, mapped) if turns is None else turns.when(chosen, mapped)
    return turns


def _of(role: str) -> Callable[[Column], Column]:
    return lambda t: t["role"] == role


def _led(read: Access, x: Layout, turns: Column) -> Column:
    """Turns after those of the texts beside them that they don't hold themselves."""
    if not x.lead:
        return turns

    def lead(said: Column) -> Column:
        first = F.coalesce(F.array_min(F.transform(said, lambda t: t["turn"])), F.lit(0).cast("long"))
        out = []
        for i, (role, path) in enumerate(x.lead):
            text = read.value(None, path, "string")
            new = (text != "") & ~F.array_contains(F.transform(F.filter(said, _of(role)), lambda t: t["text"]), text)
            at = first - F.lit(len(x.lead) - i)
            out.append(F.when(new, F.struct(at.cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))))
        return F.concat(F.array_compact(F.array(*out)), said)

    return F.get(F.transform(F.array(turns), lead), F.lit(0))


def _turns(read: Access, x: Layout) -> Column:
    if x.items:

        def one(v: Column, i: Column) -> Column:
            role = read.value(v, x.role, "string")
            for old, new in x.roles:
                role = F.when(role == old, F.lit(new)).otherwise(role)
            turn = F.coalesce(read.value(v, x.turn, "long"), i.cast("long")) if x.turn else i.cast("long")
            return F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(read.value(v, x.text, "string"), F.lit("")).alias("text"))

        return _led(read, x, F.transform(read.items(x.items), one))
    out = []
    for i, (role, paths) in enumerate(x.fields):
        parts = F.array_compact(F.array(*[F.nullif(read.value(None, p, "string"), F.lit("")) for p in paths]))
        out.append(F.when((F.size(parts) > 0) | F.lit(role != "system"), F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text"))))
    return F.array_compact(F.array(*out))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def parsed(record: Column) -> Column:
    """Variant of a JSON text, null if it isn't JSON; fails on an unparsable text that a limit of the parser may refuse."""
    found = F.try_parse_json(record)
    refused = found.isNull() & (F.length(record) > PARSER_LIMIT)
    return F.when(refused, F.raise_error(F.lit(f"a record of over {PARSER_LIMIT} characters can't be parsed; give its turns as typed columns"))).otherwise(found)


def format_chats(records: DataFrame) -> DataFrame:
    """records (conv_id, record: JSON text; several per conversation allowed) -> conv_id, formatted, loss_spans, n_turns, fingerprints.

    Turns of a conversation are ordered by (turn, role, text), so ties and repeated rows have one defined order and
    stay repeated. Null roles and texts are empty. A record that isn't JSON, or that no mapping fits, gives no turn; a
    conversation without any turn isn't returned; report_records tells which these are, and why. A record that only the parser's limit may keep from being read is an
    error. loss_spans are the code point ranges (start, end) of `formatted` that hold the escaped texts of assistant
    turns, in order. Other columns are ignored.
    """
    return _formatted(_mapped(records.select("conv_id", parsed(F.col("record")).alias("record")), variant_source(F.col("record"))))


def _mapped(records: DataFrame, source: Source) -> DataFrame:
    """conv_id, fingerprint, turns (null where no mapping fits)."""
    hashed = records.withColumn("__fingerprint", fingerprint(source))
    return hashed.select("conv_id", F.col("__fingerprint").alias("fingerprint"), canonical_turns(source, F.col("__fingerprint")).alias("turns"))


def report_records(records: DataFrame) -> DataFrame:
    """One row for each record: conv_id, status, fingerprint (null without a variant), n_turns.

    status: `mapped`; `unmapped` if no layout has its fingerprint; `unparsable` if it isn't JSON; `too_long` if that may
    be due to the parser's limit; `missing` if it is null. Only mapped records with turns reach format_chats.
    """
    read = records.select("conv_id", F.length("record").alias("n"), F.try_parse_json("record").alias("v"))
    source = variant_source(F.col("v"))
    read = read.withColumn("found", fingerprint(source)).withColumn("turns", canonical_turns(source, F.col("found")))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("v").isNull(), F.when(F.col("n") > PARSER_LIMIT, "too_long").otherwise("unparsable")).when(F.col("turns").isNull(), "unmapped").otherwise("mapped")
    return read.select("conv_id", status.alias("status"), F.when(F.col("v").isNotNull(), F.col("found")).alias("fingerprint"), F.coalesce(F.size("turns"), F.lit(0)).cast("long").alias("n_turns"))


def format_typed_chats(records: DataFrame) -> DataFrame:
    """The same for records whose fields are columns beside conv_id, each row filling those of its own layout.

    A row's fingerprint is of the fields that it fills, so one table may hold all layouts. A row that no mapping fits gives
    no turn, as above; other columns are ignored.
    """
    return _formatted(_mapped(records, typed_source(records.schema)))


def _formatted(mapped: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, n_turns, fingerprints (of the conversation's records, distinct, sorted).

    A chat is one string and, while it is put together, one group of rows, so it can have 2 GB at most.
    """
    turns = mapped.select("conv_id", "fingerprint", F.inline("turns"))
    role = F.url_encode("role")
    inner = escape(F.col("text"))
    pieces = turns.select("conv_id", "fingerprint", "turn", "role", "text", F.concat(F.lit(OPEN), role, F.lit(CLOSE)).alias("head"), inner.alias("inner"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("inner") + F.lit(len(END))
    placed = pieces.withColumn("at", F.coalesce(F.sum(length).over(by), F.lit(0)) + F.length("head"))
    placed = placed.select("conv_id", "fingerprint", F.struct("at", F.concat("head", "inner", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), (F.col("at") + F.length("inner")).alias("end"))).alias("span")).alias("t"))
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"), F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"))
    return chats.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.array_compact(F.transform("t", lambda x: x["span"])).alias("loss_spans"), F.size("t").cast("long").alias("n_turns"), "fingerprints")


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted chat."""
    segments = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda s: s != "")

    def one(s: Column) -> Column:
        at = F.instr(s, CLOSE)
        role = F.url_decode(F.substr(s, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        return F.struct(role.alias("role"), unescape(F.substr(s, at + len(CLOSE))).alias("text"))

    return F.transform(segments, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


#: A conversation whose texts hold marks of several templates.
HOSTILE = "\\### Assistant: </turn> ok"


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn -> typed records, one for each row, in three layouts by turn: `messages`, `rows` and `sharegpt`."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    shown = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    layouts = (("messages", role, "role", "content"), ("turns", role, "role", "text"), ("conversations", shown, "from", "value"))
    kind = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(len(layouts)))
    return conversations.select("conv_id", *[F.when(kind == i, F.array(F.struct("turn", said.alias(r), text.alias(t)))).alias(name) for i, (name, said, r, t) in enumerate(layouts)])


def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    extra = spark.sql("SELECT -7 AS conv_id, 0 AS turn, 'user' AS role UNION ALL SELECT -7, 1, 'assistant'").withColumn("text", F.lit(HOSTILE))
    rows = rows.unionByName(extra.select(*[F.col(c).cast(kinds[c]) for c in rows.columns]))
    chats = format_typed_chats(conversation_records(rows))
    back = chats.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join("fingerprints", ",").alias("fingerprints"),
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, md5(CASE ((coalesce(turn, 0) % 3) + 3) % 3 WHEN 0 THEN 'messages[*].content' || chr(10) || 'messages[*].role' WHEN 1 THEN 'turns[*].role' || chr(10) || 'turns[*].text'
    ELSE 'conversations[*].from' || chr(10) || 'conversations[*].value' END) AS fingerprint FROM t),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         string_agg(DISTINCT fingerprint, ',' ORDER BY fingerprint) AS fingerprints,
         sum(length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(role) + 17) AS formatted_chars
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, fingerprints
FROM c
"""
