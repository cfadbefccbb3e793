"""Chat formatting by relational means: sort collected turn structs, merge adjacent turns of a role, concatenate.

Template: ``[INST] text [/INST]`` for user, ``<s>text</s>`` for assistant, ``[SYS] text [/SYS]`` for system and
``[ROLE] name[:]text [/ROLE]`` for any other role (a null role has no ``name[:]``). Adjacent turns of one role share
a block; ``[+]`` stands between their texts. A control string inside a text gets a backslash after its first
character; one that already has backslashes there gets one more, so taking one away restores every text.

Defined results: turns are sorted by (turn, role, text), nulls first; null texts are empty; repeated rows are turns
of their own; a null conversation id is a conversation. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANGLE, _SQUARE = r"/?s>", r"(?:/?INST|/?SYS|/?ROLE|:|\+)\]"
BLOCK = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|\[SYS\] .*? \[/SYS\]|\[ROLE\] .*? \[/ROLE\]"
#: role: what opens and closes its block.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE] ", " [/ROLE]")


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, rf"<(\\*{_ANGLE})", r"<\\$1")
    return F.regexp_replace(text, rf"\[(\\*{_SQUARE})", r"[\\$1")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, rf"<\\(\\*{_ANGLE})", "<$1")
    return F.regexp_replace(text, rf"\[\\(\\*{_SQUARE})", "[$1")


def _mark(role: Column, end: int) -> Column:
    out = F.lit(OTHER[end]) if end else F.concat(F.lit(OTHER[0]), F.coalesce(F.concat(escaped(role), F.lit("[:]")), F.lit("")))
    for name, marks in MARKS.items():
        out = F.when(role.eqNullSafe(F.lit(name)), F.lit(marks[end])).otherwise(out)
    return out


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its id, formatted, and segments, an array of (piece, loss) whose pieces make up
    formatted; loss marks the texts of the assistant alone."""
    rows = df.select(F.col(conv), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    t = F.col("turns")

    def pieces(x: Column, i: Column) -> Column:
        last = F.get(t, i - 1)
        starts, ends = (i == 0) | ~last["role"].eqNullSafe(x["role"]), (i == F.size(t) - 1) | ~F.get(t, i + 1)["role"].eqNullSafe(x["role"])
        piece = lambda p, loss: F.struct(p.alias("piece"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            piece(F.when(starts, _mark(x["role"], 0)).otherwise("[+]"), no),
            piece(escaped(x["text"]), x["role"].eqNullSafe(F.lit("assistant"))),
            piece(F.when(ends, _mark(x["role"], 1)).otherwise(""), no),
        )

    out = turns.select(conv, F.flatten(F.transform(t, pieces)).alias("segments"))
    return out.select(conv, F.array_join(F.col("segments.piece"), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: an array of (role, text)."""

    def turns(block: Column) -> Column:
        role, skip, drop = F.lit(None).cast("string"), F.lit(len(OTHER[0])), F.lit(len(OTHER[1]))
        for name, (left, right) in MARKS.items():
            own = block.startswith(left)
            role, skip, drop = F.when(own, F.lit(name)).otherwise(role), F.when(own, len(left)).otherwise(skip), F.when(own, len(right)).otherwise(drop)
        body = F.substring(block, skip + 1, F.length(block) - skip - drop)
        named = block.startswith(OTHER[0]) & body.contains("[:]")
        role = F.when(named, unescaped(F.substring_index(body, "[:]", 1))).otherwise(role)
        body = F.when(named, F.substring(body, F.locate("[:]", body) + 3, F.length(body))).otherwise(body)
        return F.transform(F.split(body, r"\[\+\]", -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(BLOCK), F.lit(0)), turns))


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What op10 returns, read back from format_chats()."""
    turns = chats.select(conv, "formatted", "segments", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["piece"])), "")
    out = turns.select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select(conv, "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
