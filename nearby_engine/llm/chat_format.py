"""Chat formatting: layouts recognised by a fingerprint of their field paths, turns marked, control strings escaped.

The output of one conversation is a text ``<|turn|>role<|text|>words<|end|>...`` and the byte spans that a loss may see
(the words of assistant turns). Inside roles and words every control string, also those of other chat templates, gets
backslashes after its first character; strings that already look like this get one more, so the step is reversible and
no control string occurs in the output but the marks themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: The marks of this template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Further control strings that must not occur inside a text: (first character, rest).
CONTROL = (
    ("<", "|turn|>"), ("<", "|text|>"), ("<", "|end|>"), ("<", "|im_start|>"), ("<", "|im_end|>"), ("<", "|endoftext|>"),
    ("<", "s>"), ("<", "/s>"), ("<", "<SYS>>"), ("<", "</SYS>>"), ("[", "INST]"), ("[", "/INST]"),
)


def _pattern(more: str) -> str:
    quote = lambda s: "".join("\\" + c if c in "|[]<>/" else c for c in s)
    by_first: dict[str, list[str]] = {}
    for first, rest in CONTROL:
        by_first.setdefault(first, []).append(quote(rest))
    return "|".join(rf"(?<={quote(first)}){more}(?=\\*(?:{'|'.join(rest)}))" for first, rest in by_first.items())


#: The empty place after the first character of a control string, and one backslash there.
_BREAK, _JOIN = _pattern(""), _pattern(r"\\")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BREAK, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _JOIN, "")


# --- layouts -----------------------------------------------------------------------------------------------------------


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """All nested paths of a type, ``[]`` standing for the elements of an array."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower()))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(order: int, role: str, text: Column) -> Column:
    return F.struct(F.lit(order).cast("long").alias("turn"), F.lit(role).alias("role"), text.cast("string").alias("text"))


def _pairs(*parts: tuple[str, Callable[[], Column]]) -> Callable[[], Column]:
    return lambda: F.array(*[_turn(i, role, text()) for i, (role, text) in enumerate(parts)])


def _listed(field: str, role: str, text: str) -> Callable[[], Column]:
    made = lambda m, i: F.struct(i.cast("long").alias("turn"), m[role].cast("string").alias("role"), m[text].cast("string").alias("text"))
    return lambda: F.transform(F.col(field), made)


def _instruction() -> Column:
    extra = F.coalesce(F.col("input"), F.lit(""))
    return F.concat(F.coalesce(F.col("instruction"), F.lit("")), F.when(extra != "", F.concat(F.lit("\n"), extra)).otherwise(""))


#: Declarative mappings: the field paths beside conv_id, and the turns they mean.
LAYOUTS: dict[tuple[str, ...], Callable[[], Column]] = {
    ("role", "text", "turn"): lambda: F.array(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))),
    ("completion", "prompt"): _pairs(("user", lambda: F.col("prompt")), ("assistant", lambda: F.col("completion"))),
    ("prompt", "response"): _pairs(("user", lambda: F.col("prompt")), ("assistant", lambda: F.col("response"))),
    ("input", "instruction", "output"): _pairs(("user", _instruction), ("assistant", lambda: F.col("output"))),
    ("instruction", "output"): _pairs(("user", lambda: F.col("instruction")), ("assistant", lambda: F.col("output"))),
    ("messages[].content", "messages[].role"): _listed("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): _listed("conversations", "from", "value"),
}
MAPPINGS = {fingerprint(["conv_id", *paths]): make for paths, make in LAYOUTS.items()}
#: Names that some layouts use for the two speakers.
ROLE_NAMES = {"human": "user", "gpt": "assistant"}


def canonical_turns(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of a table whose layout is known by the fingerprint of its field paths.

    Columns that belong to no layout are set aside until a fingerprint fits: of the fitting layouts the one with most
    fields is taken. Raises ValueError if none fits.
    """
    paths = field_paths(df.schema)
    fitting = [p for p in LAYOUTS if set(p) | {"conv_id"} <= set(paths)]
    if not fitting:
        raise ValueError(f"no layout for the fields {paths}")
    make = MAPPINGS[fingerprint(["conv_id", *max(fitting, key=len)])]
    turns = df.select("conv_id", F.explode(make()).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return turns.withColumn("role", F.coalesce(names[F.col("role")], F.col("role")))


# --- writing and reading back ------------------------------------------------------------------------------------------


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start and length in UTF-8 bytes of ``formatted``).

    Turns are ordered by turn, then role and text. A null text or role is empty. A null conv_id is a conversation of its
    own; repeated rows are repeated turns. Where a turn starts is a running sum, so a long conversation costs linear work.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = clean.select(
        "conv_id", "turn", "role", escape(F.col("text")).alias("words"),
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "words")
    sized = pieces.select(
        "conv_id", "role", "head", "words", F.row_number().over(order).alias("place"),
        F.sum(F.octet_length("head") + F.octet_length("words") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"),
    )
    size = F.octet_length("words").cast("long")
    span = F.struct((F.col("stop") - len(END) - size).alias("start"), size.alias("length"))
    part = F.struct("place", F.concat("head", "words", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", span).alias("span"))
    gathered = sized.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return gathered.select(
        "conv_id", F.array_join("parts.piece", "").alias("formatted"),
        F.filter("parts.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    ended = F.filter(F.split(formatted, "\\Q" + END + "\\E"), lambda p: p != "")
    body = lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), "\\Q" + TEXT + "\\E")
    return F.transform(F.transform(ended, body), lambda b: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), unescape(F.get(b, F.lit(1))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    data = formatted.cast("binary")
    piece = lambda s: unescape(F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return F.array_join(F.transform(spans, piece), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them: counts and digests per conversation."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    back = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
