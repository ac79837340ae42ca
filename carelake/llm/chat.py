"""Relational chat formatting: sorted turn structs, merged by role and concatenated with Spark expressions only.

A conversation is written as blocks, one for each run of turns with one role:

    <|start|>role<|message|>text<|next|>text<|end|>

where <|next|> stands between the turns that a block merges. Control strings inside texts and roles are escaped by
a backslash after their first character, and backslashes are doubled, so parse() restores every turn exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"
#: Control strings of this template and of common instruction templates.
CONTROL = (START, MESSAGE, NEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"

_QUOTED = "|".join(rf"(?:\Q{c[1:]}\E)" for c in sorted(CONTROL, key=len, reverse=True) if c[0] == "<")
_BRACKETS = "|".join(rf"(?:\Q{c[1:]}\E)" for c in CONTROL if c[0] == "[")
_CONTROL = rf"<(?={_QUOTED})|\[(?={_BRACKETS})"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit(_CONTROL), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _texts(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: escape(t["text"])), NEXT)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as an array of (turn, role, text).

    A null role or text counts as empty. Equal turn numbers are ordered by role and text, null numbers come first.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chat(rows: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss_runs).

    rows has conv_id, turn, role and text. loss_runs is a run-length mask over the code points of formatted: each run
    has a length, says whether it is trained on, which the texts of assistant turns are, and whether it is a text. A conversation is one
    string and so one row, whatever its number of turns. Repeated rows are repeated turns; rows with a null conv_id
    form one conversation; extra columns are ignored; an empty table gives no rows.
    """
    turns = conversations(rows)
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("turns") + 1))
    blocks = F.zip_with(
        "starts",
        "ends",
        lambda a, b: F.struct(F.element_at("turns", a)["role"].alias("role"), F.slice("turns", a, b - a).alias("turns")),
    )
    merged = turns.withColumn("starts", starts).withColumn("ends", ends).withColumn("blocks", blocks)
    formatted = F.array_join(
        F.transform(
            "blocks", lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(MESSAGE), _texts(b["turns"]), F.lit(END))
        ),
        "",
    )

    def runs(b: Column) -> Column:
        """The mask of one block: its opening, then texts and marks in turn, then its end."""
        opening = F.length(F.lit(START)) + F.length(escape(b["role"])) + F.length(F.lit(MESSAGE))
        trained = b["role"] == TRAINED_ROLE
        inner = F.transform(
            b["turns"],
            lambda t, i: F.array(
                _run(F.when(i == 0, opening).otherwise(len(NEXT)), F.lit(False), False),
                _run(F.length(escape(t["text"])), trained, True),
            ),
        )
        return F.concat(F.flatten(inner), F.array(_run(F.lit(len(END)), F.lit(False), False)))

    mask = F.flatten(F.transform("blocks", runs))
    return merged.select("conv_id", formatted.alias("formatted"), mask.alias("loss_runs"))


def _run(n: Column, loss: Column, text: bool) -> Column:
    return F.struct(n.cast("int").alias("n"), loss.alias("loss"), F.lit(text).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    blocks = F.slice(F.split(formatted, r"\Q" + START + r"\E"), 2, 1 << 30)
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(_between(b), r"\Q" + NEXT + r"\E"),
                lambda t: F.struct(
                    unescape(F.substring_index(b, MESSAGE, 1)).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )


def _between(block: Column) -> Column:
    """What stands between a block's MESSAGE and END."""
    at = F.instr(block, MESSAGE)
    return F.substring(block, at + len(MESSAGE), F.length(block) - at + 1 - len(MESSAGE) - len(END))


def trained_text(formatted: Column, loss_runs: Column) -> Column:
    """The text under the loss mask, unescaped: what format_chat's runs mark, read from the formatted string.

    Neither control strings nor the roles between them hold a text, so splitting at those gives the texts in order;
    a run whose length isn't that of its text is an error.
    """
    mark = rf"(?s)(?:\Q{END}\E)?\Q{START}\E.*?\Q{MESSAGE}\E|\Q{NEXT}\E|\Q{END}\E$"
    pieces = F.split(formatted, mark, -1)
    texts = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    marked = F.zip_with(
        texts,
        F.filter(loss_runs, lambda r: r["text"]),
        lambda t, r: F.when(~F.equal_null(F.length(t), r["n"]), F.raise_error(F.lit("a loss run doesn't fit its text")))
        .when(r["loss"], t)
        .otherwise(""),
    )
    return unescape(F.array_join(marked, ""))


def digests(chats: DataFrame) -> DataFrame:
    """Read formatted conversations back: numbers and digests of their turns and of the text under the loss mask."""
    read = chats.withColumn("back", parse(F.col("formatted")))
    every = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.withColumn("trained", trained_text(F.col("formatted"), F.col("loss_runs"))).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
