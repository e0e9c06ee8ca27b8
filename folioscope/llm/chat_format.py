"""Conversations as one marked string each, with a loss mask, and read back from it.

The turns of a conversation are gathered as structs and sorted; runs of turns of one role become a block,
by array functions; blocks are joined. A block opens and closes with the marks of its role, the turns
inside are parted by a mark of their own, so nothing is lost by merging.

    user       [INST]text[/INST]
    assistant  <s>text</s>
    system     <<SYS>>text<</SYS>>
    others     <<ROLE>>name<<IS>>text<</ROLE>>
    a turn after one of the same role      ...text<<NEXT>>text...

A mark inside a text gets a backslash after its first character, one more if it has some there already;
taking one away gives the text again. No mark can begin in a text and end in the mark behind it or begin in
a mark and end in the text behind it, as no end of one is the beginning of another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import block_sums, running_before
from .common import held

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, IS, END_ROLE, NEXT = "<<ROLE>>", "<<IS>>", "<</ROLE>>", "<<NEXT>>"
_REST = r"(?:/?s>|</?(?:SYS|ROLE)>>|<(?:IS|NEXT)>>)"          # of a mark that begins with <
_PIECE = 4096              # characters of the pieces that a long text is cut from


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<(?=\\*{_REST})|\[(?=\\*/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<(?=\\+{_REST})|\[(?=\\+/?INST\]))\\", "$1")


def _by_role(role: Column, marks: dict[str, Column], other: Column) -> Column:
    out = None
    for name, mark in marks.items():
        out = F.when(role == name, mark) if out is None else out.when(role == name, mark)
    return out.otherwise(other)


def _opening(role: Column) -> Column:
    return _by_role(role, {r: F.lit(o) for r, (o, _) in MARKS.items()}, F.concat(F.lit(ROLE), escape(role), F.lit(IS)))


def _closing(role: Column) -> Column:
    return _by_role(role, {r: F.lit(c) for r, (_, c) in MARKS.items()}, F.lit(END_ROLE))


def gathered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation as sorted structs."""
    t = F.struct(F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_col).alias("conv"), t.alias("t"))
    one = rows.filter("conv IS NULL").select("conv", F.array("t").alias("turns"))
    return rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")).unionByName(one)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: its id, `formatted`, and `loss`, the (start, stop) in code points of each text of `loss_roles` in it.

    Turns stand by turn number, null numbers last, equal ones by role and then by text; repeated rows stay. A null role or
    text is an empty one. A row whose conversation is null is a conversation of one turn, as nothing says what it belongs to. No
    rows give no rows. Other columns are not read.

    A conversation is one row of the result and so is made in one task; it takes work in proportion to its length.
    """
    rows = gathered(turns, conv_col, turn_col, role_col, text_col)
    at = lambda i: F.get("turns", i)      # noqa: E731
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    rows = held(rows, "starts", starts)
    ends = lambda b: F.coalesce(F.get("starts", b + 1), F.size("turns")) - 1      # noqa: E731

    def block(first: Column, b: Column) -> Column:
        role = at(first)["role"]
        return F.transform(F.sequence(first, ends(b)), lambda i: F.struct(
            F.when(i == first, _opening(role)).otherwise(F.lit(NEXT)).alias("head"), escape(at(i)["text"]).alias("body"),
            F.when(i == ends(b), _closing(role)).otherwise(F.lit("")).alias("tail"), role.isin(*loss_roles).alias("loss")))
    rows = held(rows, "pieces", F.flatten(F.transform("starts", block))).drop("turns", "starts")
    rows = held(rows, "lens", F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long")))
    rows = held(rows, "sums", block_sums(F.col("lens")))
    rows = held(rows, "before", running_before(F.col("lens"), F.col("sums")))

    def span(p: Column, i: Column) -> Column:
        start = F.get("before", i) + F.length(p["head"])
        return F.struct(start.alias("start"), (start + F.length(p["body"])).alias("stop"), p["loss"].alias("loss"))
    loss = F.transform(F.filter(F.transform("pieces", span), lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return rows.select(F.col("conv").alias(conv_col), text.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as structs of role and text."""
    blocks = F.split(formatted, r"\[/INST\]|</s>|<</SYS>>|<</ROLE>>")
    blocks = F.filter(blocks, lambda b: b != "")               # only behind the last mark is there nothing

    def turns(b: Column) -> Column:
        named = F.regexp_extract(b, rf"(?s)^{ROLE}(.*?){IS}", 1)
        role = F.coalesce(*[F.when(b.startswith(o), F.lit(r)) for r, (o, _) in MARKS.items()], unescape(named))
        inside = F.regexp_replace(b, rf"(?s)^(?:\[INST\]|<s>|<<SYS>>|{ROLE}.*?{IS})", "")
        return F.transform(F.split(inside, NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def masked(df: DataFrame, name: str, formatted: str = "formatted", loss: str = "loss") -> DataFrame:
    """`df` with the column `name`: all text under the loss mask, unescaped, one piece behind the other. A long text is cut into
    pieces first, so that no cut counts its characters from the beginning."""
    df = held(df, "__pieces", F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0)))

    def cut(s: Column) -> Column:
        first = F.floor(s["start"] / _PIECE).cast("int")
        last = F.floor(s["stop"] / _PIECE).cast("int")
        near = F.array_join(F.transform(F.sequence(first, last), lambda i: F.coalesce(F.get("__pieces", i), F.lit(""))), "")
        return unescape(F.substring(near, (s["start"] - first * _PIECE + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    return df.withColumn(name, F.array_join(F.transform(loss, cut), "")).drop("__pieces")


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What is read back from formatted conversations: the turns, and the text under the loss mask."""
    rows = held(formatted, "turns", read_turns(F.col("formatted")))
    rows = held(masked(rows, "__under"), "under", F.col("__under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)      # noqa: E731
    return rows.select(conv_col, F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"),
                       sha(F.col("under")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
