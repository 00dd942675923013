"""Chat formatting: records of any layout become turns by the fingerprint of their nested field paths. SQL functions only.

A formatted conversation is a run of turns, each ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. In roles and texts a
backslash is doubled and one is put behind the first character of every control string, so that none is left; reading
back takes one backslash away from each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PIECE = 16  # turn numbers of a conversation that share a stored piece

# Strings that steer chat templates, found by their first character and what follows it.
CONTROLS = r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROLS, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\?)", "$1")


@dataclass(frozen=True)
class Mapping:
    """``turns`` is SQL over the fields of a record ``r`` that gives an array of structs (role, text)."""

    paths: tuple[str, ...]
    turns: str


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', coalesce(cast({role} AS string), ''), 'text', coalesce(cast({text} AS string), ''))"


def _answer(question: str, answer: str) -> str:
    return f"array({_turn(chr(39) + 'user' + chr(39), question)}, {_turn(chr(39) + 'assistant' + chr(39), answer)})"


def _messages(array: str, role: str, text: str) -> str:
    name = f"CASE lower(m.{role}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.{role} END"
    return f"transform(coalesce(r.{array}, array()), m -> {_turn(name, f'm.{text}')})"


#: Known layouts. [] stands for the elements of an array.
MAPPINGS = (
    Mapping(("role", "text"), f"array({_turn('r.role', 'r.text')})"),
    Mapping(("content", "role"), f"array({_turn('r.role', 'r.content')})"),
    Mapping(("prompt", "response"), _answer("r.prompt", "r.response")),
    Mapping(("completion", "prompt"), _answer("r.prompt", "r.completion")),
    Mapping(("answer", "question"), _answer("r.question", "r.answer")),
    Mapping(("instruction", "output"), _answer("r.instruction", "r.output")),
    Mapping(("input", "instruction", "output"), _answer("concat_ws(chr(10), r.instruction, nullif(r.input, ''))", "r.output")),
    Mapping(("messages[].content", "messages[].role"), _messages("messages", "role", "content")),
    Mapping(("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return field_paths(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else [at]


def _tree(paths: tuple[str, ...]) -> dict:
    tree: dict = {}
    for path in paths:
        node = tree
        for step in path.replace("[]", ".[]").split("."):
            node = node.setdefault(step, {})
    return tree


def _shape(node: dict) -> str:
    """How a shape is written: OBJECT<names in order>, ARRAY<element>; scalars have no type."""
    if not node:
        return ""
    if "[]" in node:
        return f"ARRAY<{_shape(node['[]'])}>"
    return "OBJECT<" + ", ".join(k + (f": {_shape(v)}" if v else "") for k, v in sorted(node.items())) + ">"


def _schema(node: dict) -> str:
    if not node:
        return "string"
    if "[]" in node:
        return f"array<{_schema(node['[]'])}>"
    return "struct<" + ", ".join(f"{k}: {_schema(v)}" for k, v in sorted(node.items())) + ">"


def fingerprint(shape: Column) -> Column:
    return F.sha2(shape, 256)


def canonical(records: DataFrame, ids: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``ids`` and turns (array of role and text) of a table whose other columns are a record.

    The hash of the record's nested field paths selects the mapping; a table of unknown layout is an error that names
    its paths. Null texts and roles are empty.
    """
    fields = [f for f in records.schema.fields if f.name not in ids]
    paths = tuple(sorted(field_paths(T.StructType(fields))))
    known = {hashlib.sha256(_shape(_tree(m.paths)).encode()).hexdigest(): m for m in mappings}
    mapping = known.get(hashlib.sha256(_shape(_tree(paths)).encode()).hexdigest())
    if mapping is None:
        raise ValueError(f"no mapping for the layout {list(paths)}")
    record = F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("r")
    return records.select(F.struct(*[F.col(f"`{c}`") for c in ids]).alias("ids"), record).select("ids.*", F.expr(mapping.turns).alias("turns"))


def canonical_json(records: DataFrame, column: str, ids: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``ids`` and turns of JSON records of mixed layouts, one a row.

    Each record's own field paths are hashed, and the hash selects the mapping of that row. A record of an unknown
    layout, a null and broken JSON have null turns: they stay, to be counted. An array that is empty has no element
    fields; such a record of a message layout has no turns. Scalars of any type are read as text.
    """
    json = F.col(f"`{column}`")
    typed = F.schema_of_variant(F.try_parse_json(json))
    untyped = F.regexp_replace(F.regexp_replace(typed, r": (?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9, ]+\))?", ""), "ARRAY<[A-Z_]+>", "ARRAY<>")
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in ids]).alias("ids"), json.alias("json"), fingerprint(untyped).alias("print"))
    chosen = "CAST(NULL AS array<struct<role: string, text: string>>)"
    for m in mappings:
        tree = _tree(m.paths)
        shapes = [_shape(tree)] + ([f"OBJECT<{k}: ARRAY<>>" for k, v in tree.items() if "[]" in v])
        prints = ", ".join(f"'{hashlib.sha256(x.encode()).hexdigest()}'" for x in shapes)
        chosen = f"CASE WHEN print IN ({prints}) THEN transform(array(from_json(json, '{_schema(tree)}')), r -> {m.turns})[0] ELSE {chosen} END"
    return rows.select("ids.*", F.expr(chosen).alias("turns"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss) of a table (conv_id, turn, turns): canonical turns in the order of ``turn``.

    A conversation is the run of its pieces, each of ``PIECE`` turn numbers. ``loss`` has the places (start, end; code
    points of the piece) of the assistant's texts, all that a model is to learn. Rows with equal turn numbers follow by
    role and text, a null turn comes first, null conv_ids are one conversation. Null and empty turns lists add nothing;
    an empty table gives no rows.
    """
    rows = turns.select("conv_id", "turn", F.posexplode("turns").alias("at", "t"))
    piece = F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 62))).cast("long")
    parts = rows.select("conv_id", piece.alias("piece"), F.struct("turn", "at", F.col("t.role").alias("role"), F.col("t.text").alias("text")).alias("t"))
    whole = parts.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("t")).alias("t"))
    written = whole.select("conv_id", "piece", F.transform("t", lambda t: F.struct(
        (t["role"] == "assistant").alias("learn"), F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"))).alias("t"))
    tail = len(END) + 1
    sized = written.withColumn("size", F.transform("t", lambda t: F.length(t["head"]) + F.length(t["body"]) + tail))

    def place(t: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("size", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(t["head"])
        return F.struct(start.alias("start"), (start + F.length(t["body"])).alias("end"), t["learn"].alias("learn"))

    loss = F.transform(F.filter(F.transform("t", place), lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    formatted = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return sized.select("conv_id", "piece", F.size("t").alias("n_turns"), formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, piece, turns, learned) back from ``format_turns``: roles and texts as they were, and all text under the loss mask."""
    parts = F.filter(F.split("formatted", rf"\Q{END}\E\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        sides = F.split(F.substring(p, len(START) + 1, 1 << 30), rf"\Q{SEP}\E", 2)
        return F.struct(unescape(sides[0]).alias("role"), unescape(sides[1]).alias("text"))

    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.select("conv_id", "piece", F.transform(parts, turn).alias("turns"), learned.alias("learned"), F.length("formatted").alias("chars"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation: how many turns, digests of the turns and of the learned text, and sizes."""
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    pieces = read.select("conv_id", F.size("turns").alias("n"), "chars", F.struct("piece", flat.alias("flat"), "learned").alias("p"))
    whole = pieces.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("p")).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["flat"]), "")
    learned = F.array_join(F.transform("p", lambda p: p["learned"]), "")
    return whole.select("conv_id", F.col("n_turns").cast("long"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
                        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
