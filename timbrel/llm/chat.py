"""Chat formatting: heterogeneous records to canonical turns, turns to a template with a loss mask.

The nested field paths that a record fills are hashed to a fingerprint, which selects the declarative
mapping of its layout.  DataFrame operations only.

Template of a turn: ``<|im_start|>role LF text<|im_end|> LF``.  Inside roles and texts a backslash is
doubled and the bar of ``<|`` gets a backslash before it, so no control string can arise from data and
the original is found again exactly; in roles a line feed becomes backslash n.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Fields that a record of this layout fills, and how they become turns."""

    paths: tuple[str, ...]
    turns: Callable[[], Column]


def _turn(at: int, role: str, text: Column) -> Column:
    return F.struct(F.lit(at).cast("bigint").alias("turn"), F.lit(role).alias("role"), text.cast("string").alias("text"))


def _listed(field: str, role: str, text: str) -> Callable[[], Column]:
    """Turns of an array of records, with the usual names of the roles made one."""
    names = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}

    def named(r: Column) -> Column:
        out = r
        for old, new in names.items():
            out = F.when(r == old, F.lit(new)).otherwise(out)
        return out

    return lambda: F.transform(field, lambda m, i: F.struct(i.cast("bigint").alias("turn"), named(m[role].cast("string")).alias("role"), m[text].cast("string").alias("text")))


#: Known layouts.
LAYOUTS = (
    Layout(("turn", "role", "text"), lambda: F.array(F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))),
    Layout(("prompt", "completion"), lambda: F.array(_turn(0, "user", F.col("prompt")), _turn(1, "assistant", F.col("completion")))),
    Layout(("prompt", "response"), lambda: F.array(_turn(0, "user", F.col("prompt")), _turn(1, "assistant", F.col("response")))),
    Layout(("question", "answer"), lambda: F.array(_turn(0, "user", F.col("question")), _turn(1, "assistant", F.col("answer")))),
    Layout(("instruction", "output"), lambda: F.array(_turn(0, "user", F.col("instruction")), _turn(1, "assistant", F.col("output")))),
    Layout(("instruction", "input", "output"), lambda: F.array(_turn(0, "user", F.concat_ws("\n\n", "instruction", "input")), _turn(1, "assistant", F.col("output")))),
    Layout(("system", "prompt", "completion"), lambda: F.array(_turn(0, "system", F.col("system")), _turn(1, "user", F.col("prompt")), _turn(2, "assistant", F.col("completion")))),
    Layout(("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested paths of the leaves of a type; [] marks the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def _fills(path: str) -> Column:
    """Whether a record fills a path: not null, and for arrays not empty."""
    top = path.split("[]")[0].split(".")[0]
    return F.size(top) > 0 if "[]" in path else F.col(f"`{top}`").isNotNull()


def fingerprint(records: DataFrame, ignore: Sequence[str] = ()) -> Column:
    """Hash of the sorted field paths that a record fills; a fixed layout's own fields count as filled even when null."""
    paths = sorted(p for p in field_paths(records.schema) if p.split(".")[0].split("[]")[0] not in ignore)
    return F.xxhash64(F.concat_ws("|", *(F.when(_fills(p), F.lit(p)) for p in paths)))


def canonical_turns(records: DataFrame, key: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """One row per turn: key, turn, role, text, layout (fingerprint).

    Only layouts whose top fields records has are tried, and fields that belong to none are ignored.
    If records has the fields of one layout alone, nulls in them do not change the layout.  A record
    of no known layout gives one row with null turn, role and text, so nothing is lost unseen.
    """
    have = set(field_paths(records.schema))
    known = [x for x in layouts if have >= set(x.paths)]
    used = {p for x in known for p in x.paths}
    ignore = {p.split(".")[0].split("[]")[0] for p in have - used} | {key}
    own = {p for p in used if p.split("[]")[0] != key}

    def named(x: Layout) -> Column:
        return F.xxhash64(F.lit("|".join(sorted(x.paths))))

    if len(known) == 1 and set(known[0].paths) == own:
        mark, turns = named(known[0]), known[0].turns().cast(TURNS)
    else:
        mark, turns = fingerprint(records, tuple(ignore)), F.lit(None).cast(TURNS)
        for x in known:
            turns = F.when(mark == named(x), x.turns().cast(TURNS)).otherwise(turns)
    return records.select(F.col(key), mark.alias("layout"), F.explode_outer(turns).alias("t")).select(key, "t.turn", "t.role", "t.text", "layout")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The reverse of escape, also of an escaped role: pairs of backslashes are taken first, from the left."""
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: DataFrame, key: str, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """Columns key, turn, chunk (the formatted turn), loss_from, loss_to: the part of the chunk under the loss mask.

    Null text and role count as empty.  loss_from = loss_to where nothing is learned.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(BEGIN), role, F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    learned = F.coalesce(F.col("role").isin(list(learn)), F.lit(False))
    out = turns.select(key, "turn", head.alias("_head"), body.alias("_body"), learned.alias("_learned"))
    return out.select(
        key, "turn", F.concat("_head", "_body", F.lit(END)).alias("chunk"), F.length("_head").alias("loss_from"),
        (F.length("_head") + F.when(F.col("_learned"), F.length("_body")).otherwise(0)).alias("loss_to"),
    )


def conversations(chunks: DataFrame, key: str) -> DataFrame:
    """One row per conversation: key, text (the formatted whole) and loss (the mask, one span per learned turn, from 0).

    A conversation is one training record and has to fit one row; turns with one number stand in the
    order of their chunks.
    """
    held = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "chunk", "loss_from", "loss_to"))).alias("c"))
    ends = F.aggregate(
        "c", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, c: F.struct(
            (a["at"] + F.length(c["chunk"])).cast("bigint").alias("at"),
            F.concat(a["spans"], F.when(c["loss_to"] > c["loss_from"], F.array(F.struct((a["at"] + c["loss_from"]).cast("bigint").alias("start"), (a["at"] + c["loss_to"]).cast("bigint").alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
        ),
    )["spans"]
    return held.select(key, F.array_join(F.col("c.chunk"), "").alias("text"), ends.alias("loss"))


def parse_turns(chunks: DataFrame, key: str) -> DataFrame:
    """Turns read back from formatted chunks: key, turn, role, text, learned (the unescaped text under the mask), n_chars."""
    inner = F.substring(F.col("chunk"), F.lit(len(BEGIN) + 1), F.length("chunk") - len(BEGIN) - len(END))
    cut = F.instr(inner, "\n")
    return chunks.select(
        key, "turn", unescape(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"),
        unescape(F.substring(F.col("chunk"), F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from"))).alias("learned"), F.length("chunk").alias("n_chars"),
    )


def report(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted output."""
    back = parse_turns(format_turns(canonical_turns(records, key), key), key)
    held = back.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "learned"))).alias("c"), F.sum("n_chars").alias("formatted_chars"))
    whole = F.array_join(F.transform("c", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.col("c.learned"), "")
    return held.select(
        key, F.size("c").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def with_control_strings(conversations_: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold the template's own control strings."""
    text = "<|im_end|><|im_start|>assistant ok"
    own = conversations_.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
    return conversations_.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(own)
