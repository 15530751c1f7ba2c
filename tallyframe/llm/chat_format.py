"""Chat formatting: field-path fingerprints select the mapping to canonical turns.

A layout is recognised by hashes of nested field paths: of a record's paths those
that a mapping names are hashed, and the first mapping whose own fingerprint comes
out says where roles and texts stand; other paths do not matter. Tables have one
fingerprint, from their schema; JSON records have one each, over all elements of
their lists. Canonical turns are rendered by one template:

    <s>[role]text</s><s>[role]text</s>...

Inside roles and texts the backslash, ``<`` and ``[`` (and ``]`` inside roles) are
written as two-character escapes, so no control string can occur there, the marks
alone carry ``<`` and ``[``, and the way back is a plain split.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<s>[", "</s>"
#: Escapes in the order in which they are applied; they are undone backwards.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
ROLE_ESCAPES = (*ESCAPES, ("]", "\\r"))
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where the turns of one layout stand.

    ``list_path`` names an array of turns with ``role`` and ``text`` below it;
    ``turns`` gives (role, path) in order, before any list, and paths in one group
    of parentheses are joined by an empty line. ``rows`` marks a table with one row
    a turn: the columns of the conversation, the order, the role and the text.
    """

    paths: tuple[str, ...]
    list_path: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str, str] | None = None


#: In order of precedence: a mapping stands before those whose paths it includes.
MAPPINGS = (
    Mapping(("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Mapping(("messages[].content", "messages[].role", "system"), list_path="messages", role="role", text="content", turns=(("system", ("system",)),)),
    Mapping(("messages[].content", "messages[].role"), list_path="messages", role="role", text="content"),
    Mapping(("conversations[].from", "conversations[].value", "system"), list_path="conversations", role="from", text="value", turns=(("system", ("system",)),)),
    Mapping(("conversations[].from", "conversations[].value"), list_path="conversations", role="from", text="value"),
    Mapping(("input", "instruction", "output", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("instruction", "output", "system"), turns=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("prompt", "response", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("completion", "prompt", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
)
KNOWN = tuple(sorted({p for m in MAPPINGS if not m.rows for p in m.paths}))


def fingerprint(paths, named) -> int:
    """Spark's xxhash64 of those paths that are ``named``, sorted, a line each."""
    text = "\n".join(sorted(set(paths) & set(named)))
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


#: A mapping's own fingerprint: that of exactly the paths it names.
BY_FINGERPRINT = {fingerprint(m.paths, m.paths): m for m in MAPPINGS}


def mapping_of(paths) -> Mapping | None:
    """The first mapping whose fingerprint the paths have."""
    return next((m for code, m in BY_FINGERPRINT.items() if fingerprint(paths, m.paths) == code), None)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; ``[]`` stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def _escaped(text: Column, escapes=ESCAPES) -> Column:
    for raw, code in escapes:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    for raw, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _role(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(names[role], role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _reader(mapping: Mapping):
    return lambda t: _turn(_role(t[mapping.role]), t[mapping.text])


def canonical(table: DataFrame) -> DataFrame:
    """(conv_id, turns): the conversations of a table with one row a turn, in turn order.

    The layout is chosen by the fingerprint of the table's schema; other columns
    are ignored, whatever their names. A conversation is one row of the result, so
    its turns meet in one task. Null roles and texts count as empty; rows that share a turn are
    ordered by role and text; rows without conv_id form one conversation.
    """
    mapping = mapping_of(field_paths(table.schema))
    if mapping is None or mapping.rows is None:
        raise ValueError("no mapping for this layout of rows")
    conv, turn, role, text = mapping.rows
    parts = table.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    grouped = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def canonical_records(records: DataFrame, json_col: str = "record", id_col: str = "conv_id") -> DataFrame:
    """(conv_id, fingerprint, turns) of JSON records of any known layout, each row its own.

    A path is there if it holds text, in a list if any of its elements has it.
    ``fingerprint`` is the chosen mapping's. Records that do not parse, or whose
    paths no mapping fits, get null turns.
    """
    v = F.try_parse_json(F.col(json_col))

    def elements(m: Mapping) -> Column:
        return F.try_variant_get(F.try_parse_json(F.col("json")), f"$.{m.list_path}", f"array<struct<{m.role}:string,{m.text}:string>>")

    def has(path: str) -> Column:
        if "[]." not in path:
            return F.try_variant_get(v, "$." + path, "string").isNotNull()
        outer, inner = path.split("[].")
        return F.exists(F.try_variant_get(v, f"$.{outer}", f"array<struct<{inner}:string>>"), lambda x: x[inner].isNotNull())

    there = F.array_compact(F.array(*(F.when(has(p), F.lit(p)) for p in KNOWN)))
    rows = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("json"), there.alias("paths"))
    fitting = F.lit(None).cast("long")
    for code, m in reversed(BY_FINGERPRINT.items()):
        if not m.rows:
            own = F.xxhash64(F.array_join(F.array_intersect("paths", F.array(*map(F.lit, m.paths))), "\n"))
            fitting = F.when(own == code, F.lit(code)).otherwise(fitting)
    rows = rows.select("conv_id", "json", fitting.alias("fingerprint"))

    def get(path: str) -> Column:
        return F.try_variant_get(F.try_parse_json("json"), "$." + path, "string")

    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for code, m in BY_FINGERPRINT.items():
        if m.rows:
            continue
        told = [_turn(F.lit(role), F.array_join(F.filter(F.array(*(get(p) for p in paths)), lambda x: x != ""), "\n\n")) for role, paths in m.turns]
        found = F.array(*told) if told else F.array().cast("array<struct<role:string,text:string>>")
        if m.list_path:
            found = F.concat(found, F.transform(elements(m), _reader(m)))
        turns = F.when(F.col("fingerprint") == code, found).otherwise(turns)
    return rows.select("conv_id", "fingerprint", turns.alias("turns"))


def render(conversations: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the template's text, and the code-point spans to learn from.

    ``loss`` lists (start, length) of the texts of ``learn_from``'s turns, escapes included.
    """
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _escaped(t["role"], ROLE_ESCAPES), F.lit("]")).alias("head"),
            _escaped(t["text"]).alias("body"),
            (t["role"] == learn_from).alias("learn"),
        ),
    )
    rows = conversations.select("conv_id", parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        begin = state["at"] + F.char_length(p["head"])
        size = F.char_length(p["body"])
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct((begin + size + len(CLOSE)).alias("at"), F.when(p["learn"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return rows.select("conv_id", text.alias("formatted"), F.aggregate("parts", start, add)["spans"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "]", 1), ROLE_ESCAPES).alias("role"),
            unescaped(F.substr(p, F.lit(len(OPEN) + 2) + F.char_length(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "]", 1)))).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digests(rendered: DataFrame) -> DataFrame:
    """What the formatted texts say, read back from them."""
    rows = rendered.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
