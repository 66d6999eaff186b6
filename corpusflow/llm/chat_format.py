r"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record's nested field paths (names and nesting, not scalar types), as far as any
mapping names them, are written as one string and hashed.  The hash selects a
mapping: where the turns lie and which fields or literals give role and text.  Paths
that no mapping names (ids, dates, scores) don't enter the hash, so they don't hide a
layout.  A record whose named paths are those of several mappings, or more than those
of one, gets the mapping of most paths that it has in full.  JSON strings are
fingerprinted row by row through their variant, so that records of many layouts can
share a column; typed columns have one fingerprint, known from the schema.  Canonical
turns then go through one template:

    <|turn|>ROLE<|text|>TEXT<|end|>

Control strings inside roles and texts get a backslash after their first character;
those that have k backslashes there get k + 1, so that unescaping takes one away
and every text comes back.  The loss mask lists the spans (start, length in code
points) of assistant texts within the formatted string.

DataFrame functions only, row by row; only rows_to_records() shuffles, by conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common others.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([<\[])(\\*)({_TAILS})"
UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"

#: Roles of layouts that have names of their own for them; other layouts' roles stay as they are.
SHARED_ROLES = {"human": "user", "gpt": "assistant"}
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class ListOfTurns:
    """Turns are the items of an array; roles: names that stand for canonical ones in this layout."""

    at: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return (f"{self.at}[]", f"{self.at}[].{self.role}", f"{self.at}[].{self.text}")


@dataclass(frozen=True)
class Fields:
    """Turns are fields of the record: (role, field paths whose non-empty texts are joined by a blank line)."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(p for _, ps in self.turns for p in ps)


#: Layouts; of two that a record has in full the one of more paths counts, of equally many the first.
MAPPINGS: tuple[ListOfTurns | Fields, ...] = (
    ListOfTurns("messages", "role", "content"),
    ListOfTurns("conversations", "from", "value", tuple(SHARED_ROLES.items())),
    ListOfTurns("dialog", "speaker", "text"),
    Fields((("user", ("prompt",)), ("assistant", ("response",)))),
    Fields((("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields((("user", ("question",)), ("assistant", ("answer",)))),
    Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Fields((("user", ("instruction",)), ("assistant", ("output",)))),
    Fields((("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields((("user", ("data.prompt",)), ("assistant", ("data.response",)))),
)
#: All paths that a mapping names, in the order in which fingerprints list them.
PATHS = tuple(sorted({p for m in MAPPINGS for p in m.paths}))
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_TURNS = "array<struct<role:string,text:string>>"


def paths_of(kind: T.DataType, at: str = "") -> set[str]:
    """All field paths of a type."""
    if isinstance(kind, T.ArrayType):
        return {at + "[]"} | paths_of(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for name in [f"{at}.{f.name}" if at else f.name] for p in {name} | paths_of(f.dataType, name)}
    return set()


def _has(v: Column, path: str) -> Column:
    """Whether a variant has a path of PATHS; an array's items count together."""
    if "[]" not in path:
        return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()
    at, _, field = path.partition("[]")
    items = F.try_variant_get(v, f"$.{at}", "array<variant>")
    return items.isNotNull() if not field else F.coalesce(F.exists(items, lambda x: F.try_variant_get(x, f"${field}", "variant").isNotNull()), F.lit(False))


def paths_of_variant(v: Column) -> Column:
    """The paths of PATHS that each row's variant has, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(_has(v, p), F.lit(p)) for p in PATHS])), ",")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def fingerprint_of(paths: set[str]) -> Column:
    return fingerprint(F.lit(",".join(p for p in PATHS if p in paths)))


def _role(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    role = F.coalesce(role, F.lit(""))
    for name, canonical in names:
        role = F.when(role == name, canonical).otherwise(role)
    return role


def _of_list(items: Column, m: ListOfTurns) -> Column:
    return F.transform(F.coalesce(items, F.array().cast(items_type(m))), lambda t: F.struct(_role(t[m.role], m.roles).alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text")))


def items_type(m: ListOfTurns) -> str:
    return f"array<struct<`{m.role}`:string,`{m.text}`:string>>"


def _of_fields(get, m: Fields) -> Column:
    def text(paths):
        one = [F.coalesce(get(p), F.lit("")) for p in paths]
        return one[0] if len(one) == 1 else F.array_join(F.filter(F.array(*one), lambda x: x != ""), "\n\n")

    return F.array(*[F.struct(F.lit(r).alias("role"), text(p).alias("text")) for r, p in m.turns])


def chosen(paths: set[str]) -> ListOfTurns | Fields | None:
    """The mapping of a record with these paths: of most paths among those that it has in full.

    An array without items has no paths inside; it is a layout without turns.
    """
    full = [m for m in MAPPINGS if set(m.paths) <= paths or isinstance(m, ListOfTurns) and paths & set(m.paths) == {m.paths[0]} and not any(set(x.paths) <= paths for x in MAPPINGS)]
    return max(full, key=lambda m: len(m.paths), default=None)


def turns_of_struct(record: Column, kind: T.StructType) -> Column:
    """Canonical turns of a typed column; null if no mapping has its paths."""
    m = chosen(paths_of(kind))
    if m is None:
        return F.lit(None).cast(_TURNS)

    def get(path: str) -> Column:
        value = record
        for p in path.split("."):
            value = value[p]
        return value.cast("string")

    if isinstance(m, ListOfTurns):
        return F.when(record.isNotNull(), _of_list(F.transform(record[m.at], lambda t: F.struct(t[m.role].cast("string").alias(m.role), t[m.text].cast("string").alias(m.text))), m))
    return F.when(record.isNotNull(), _of_fields(get, m))


def turns_of_json(record: Column) -> Column:
    """Canonical turns of each row's JSON; null if it is no JSON or no mapping has its paths."""

    def body(v: Column) -> Column:
        made = []
        for m in MAPPINGS:
            if isinstance(m, ListOfTurns):
                made.append(_of_list(F.try_variant_get(v, f"$.{m.at}", items_type(m)), m))
            else:
                made.append(_of_fields(lambda p: F.try_variant_get(v, f"$.{p}", "string"), m))

        def select(paths: Column) -> Column:
            mark, out = fingerprint(paths), F
            for m, turns in zip(MAPPINGS, made, strict=True):  # the whole fingerprint, also of an array without items
                out = out.when(mark == fingerprint_of(set(m.paths)), turns)
                out = out.when(mark == fingerprint_of({m.paths[0]}), turns) if isinstance(m, ListOfTurns) else out
            named = F.split(paths, ",")
            for m, turns in sorted(zip(MAPPINGS, made, strict=True), key=lambda x: -len(x[0].paths)):  # more paths than one mapping's
                out = out.when(F.size(F.array_except(F.array(*map(F.lit, m.paths)), named)) == 0, turns)
            return out

        return let(paths_of_variant(v), select)

    return let(F.try_parse_json(record), body)


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def formatted(turns: Column) -> Column:
    """struct(text, loss): the formatted conversation and its mask; null turns give null."""

    def body(ts: Column) -> Column:
        text = F.array_join(F.transform(ts, lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), "")
        fixed = len(TURN) + len(TEXT) + len(END)
        zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            n = F.char_length(t["text"])
            start = acc["at"] + len(TURN) + F.char_length(t["role"]) + len(TEXT)
            span = F.array(F.struct(start.cast("int").alias("start"), n.cast("int").alias("length")))
            return F.struct((acc["at"] + fixed + F.char_length(t["role"]) + n).cast("int").alias("at"), F.when(t["role"] == LOSS_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.struct(text.alias("text"), F.aggregate(ts, zero, step)["spans"].alias("loss"))

    return let(F.transform(turns, lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))), body)


def read_turns(text: Column) -> Column:
    """Turns back from a formatted conversation."""
    pieces = F.filter(F.split(text, re.escape(END), -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        return let(
            F.split(F.substring(p, len(TURN) + 1, 2**31 - 1), re.escape(TEXT), 2),
            lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")),
        )

    return F.transform(pieces, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """Unescaped texts under the mask."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"])))


def rows_to_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows (conv_id, turn, role, text): struct<messages:array<struct<role,content>>>.

    Turns are sorted by turn (null first), then role, then text, so that ties have one
    order; repeated rows stay; rows of a null conv_id are one conversation.
    """
    item = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    return grouped.select("conv_id", F.struct(F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")).alias("record"))


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """records with turns, formatted (text) and loss (mask) added in place of such columns.

    Defined cases: a record that is null, isn't JSON or has no mapping gets nulls; a
    record without turns an empty text; null roles and texts count as empty; fields that
    no mapping names are ignored; roles stay as read, but for the names that a layout
    declares; of two keys of one name in a JSON record the text is no JSON; extra columns
    pass, those called turns, formatted or loss are replaced.
    """
    kind = records.schema[column].dataType
    turns = turns_of_json(F.col(column)) if isinstance(kind, T.StringType) else turns_of_struct(F.col(column), kind)
    out = records.drop("turns", "formatted", "loss", "__f").withColumn("turns", turns)
    return out.withColumn("__f", formatted(F.col("turns"))).withColumn("formatted", F.col("__f.text")).withColumn("loss", F.col("__f.loss")).drop("__f")
