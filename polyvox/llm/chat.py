"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own, written out: all earlier turns are its
context, and only that reply carries loss. By nature a conversation's examples are as large as the square of its turns; they
are made one row at a time from the conversation's formatted turns, and never shuffled or held together. Turns after the last
reply go into a last row without a target, so that the last row of a conversation always holds all of it.

Template: <|im_start|>role NEWLINE text<|im_end|>NEWLINE. Inside roles and texts
every "<" + backslashes + "|" gets one more backslash, so that neither mark can
occur there, and loses it again when read; a role is kept on one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As escape, and kept on one line: percent signs and line ends become %25 and %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, last, text, target_start, target_chars.

    Turns stand in the order of (turn, role, text), nulls first; null roles and
    texts are empty, a null conv_id is a conversation like any other, and
    repeated rows are turns of their own. text is all turns up to the reply, formatted; its target is the `target_chars`
    characters from `target_start` (from 0), in escaped form; null where a last row ends with other
    turns. last: whether text is the whole conversation. Other columns are not read; an empty table gives no rows.
    A conversation's turns must fit one row, as must its longest example.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = grouped.select(
        "conv_id",
        F.transform("turns", lambda t: format_turn(t["role"], t["text"])).alias("parts"),
        F.transform("turns", lambda t: F.when(t["role"] == "assistant", F.char_length(escape(t["text"])))).alias("replies"),
    )
    # One row for each turn that ends an example; only then is its text put together.
    ends = formatted.select("conv_id", "parts", F.posexplode("replies").alias("end", "reply_chars")).where("reply_chars is not null or end = size(parts) - 1")
    row = ends.select("conv_id", "end", (F.col("end") == F.size("parts") - 1).alias("last"), "reply_chars", F.array_join(F.slice("parts", F.lit(1), F.col("end") + 1), "").alias("text"))
    return row.select(
        "conv_id",
        F.col("end").alias("example"),
        "last",
        "text",
        (F.char_length("text") - len(END + "\n") - F.col("reply_chars")).cast("long").alias("target_start"),
        F.col("reply_chars").cast("long").alias("target_chars"),
    )


def context_and_target(examples: DataFrame) -> DataFrame:
    """conv_id, example, context (up to where the reply begins, formatted) and target (the reply itself) of each example with a target."""
    start, chars = F.col("target_start").cast("int"), F.col("target_chars").cast("int")
    rows = examples.where(F.col("target_start").isNotNull())
    return rows.select("conv_id", "example", F.substring("text", F.lit(1), start).alias("context"), unescape(F.substring("text", start + 1, chars)).alias("target"))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the example rows alone.

    formatted_chars is the summed length of all examples, contexts included. What is brought together of a conversation is
    its targets and its last row, which holds all turns.
    """
    target = F.substring(F.col("text"), (F.col("target_start") + 1).cast("int"), F.col("target_chars").cast("int"))
    narrow = examples.select("conv_id", "example", target.alias("target"), F.char_length("text").cast("long").alias("chars"), F.when(F.col("last"), F.col("text")).alias("whole"))
    grouped = narrow.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("rows"),
        F.max("whole").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
    )
    pieces = F.filter(F.split("whole", r"<\|im_start\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.char_length(role) + 2, F.char_length(piece))
        text = F.substring(body, F.lit(1), F.char_length(body) - len(END) - 1)
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    loss = F.array_join(F.transform("rows", lambda r: unescape(r["target"])), "")
    return grouped.select("conv_id", "formatted_chars", F.transform(pieces, turn).alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
