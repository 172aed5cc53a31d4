"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is trainable.
What follows the last assistant turn (or a conversation without one) closes as an example without a trainable part, so
no turn of the table is lost.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Where a role or text holds a control string of this or
another common template, one backslash is put behind the string's first sign; a control string that already has
backslashes there gets one more, so taking one away again gives the text back in every case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: fixed values: what follows the first sign of the control strings of common chat templates
CONTROL_TAILS = r"(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\])"
PLAIN, QUOTED = r"([<\[])(\\*)" + CONTROL_TAILS, r"([<\[])\\(\\*)" + CONTROL_TAILS
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """``text`` without any control string; :func:`unescape` gives it back."""
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, QUOTED, "$1$2$3")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(MIDDLE), escape(text), F.lit(END))


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, example, n_turns, text, loss_start, loss_end, closing``: the training examples of all conversations.

    ``example`` counts a conversation's examples from 1; ``text`` is the formatted example with ``n_turns`` turns.  Its
    trainable part lies from code point ``loss_start`` to before ``loss_end`` (equal where nothing is trainable) and is
    the escaped text of the last turn.  ``closing`` marks the example that holds the whole conversation.

    Turns are ordered by ``turn``, null first; of equal turns by role and text, and rows that repeat are turns like any
    others.  A null role or text is empty.  Rows with a null ``conv_id`` form one conversation.  Other columns are not
    read.  An empty table gives an empty table.  A conversation is a string of the last of its examples, so by definition
    it has to fit one value of Spark (2 GB); examples before it are prefixes of this string and are made one by one.
    """
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("n", F.row_number().over(order)).withColumn("piece", format_turn(F.col("role"), F.col("text")))
    placed = placed.withColumn("end", F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    trains = F.col("role") == ASSISTANT
    placed = placed.withColumn("example", F.sum(trains.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marks = F.struct(
        "n", F.col("end").cast("int").alias("end"), trains.alias("trains"), "example", (F.col("end") - len(END)).cast("int").alias("loss_end"),
        F.when(trains, F.col("end") - len(END) - F.char_length(escape(F.col("text")))).otherwise(F.col("end") - len(END)).cast("int").alias("loss_start"), "piece",
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(marks)).alias("turns"))
    whole = whole.select("conv_id", F.array_join("turns.piece", "").alias("whole"), F.size("turns").alias("size"), F.transform("turns", lambda t: t.dropFields("piece")).alias("turns"))
    targets = F.filter("turns", lambda t: t["trains"] | (t["n"] == F.col("size")))
    each = whole.select("conv_id", "whole", "size", F.explode(targets).alias("t"))
    return each.select(
        "conv_id", (F.col("t.example") + F.when(F.col("t.trains"), 0).otherwise(1)).alias("example"), F.col("t.n").alias("n_turns"),
        F.expr("left(whole, t.end)").alias("text"), "t.loss_start", "t.loss_end", (F.col("t.n") == F.col("size")).alias("closing"),
    )


def read_turns(text: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted example."""
    # control strings occur only as marks, so literal splits are exact; the first part is what precedes the first turn
    parts = F.slice(F.split(text, r"<\|im_start\|>"), 2, F.char_length(text) + 1)
    head = lambda p: F.substring_index(p, MIDDLE, 1)
    body = lambda p: F.substring(p, F.char_length(head(p)) + len(MIDDLE) + 1, F.char_length(p) - F.char_length(head(p)) - len(MIDDLE) - len(END))
    return F.transform(parts, lambda p: F.struct(unescape(head(p)).alias("role"), unescape(body(p)).alias("text")))


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The text under the mask of an example, unescaped."""
    return unescape(F.substring(text, start + 1, end - start))


def digests(formatted: DataFrame) -> DataFrame:
    """What :func:`examples` holds of each conversation, read back from its rows: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    turns = F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # only the closing example holds all turns, so only that is taken apart
    lines = F.when(F.col("closing"), F.array_join(turns, ""))
    read = formatted.select(
        "conv_id", "example", F.when(F.col("closing"), F.size(F.split("text", r"<\|im_start\|>")) - 1).alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"), F.char_length("text").cast("long").alias("chars"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    per = read.groupBy("conv_id").agg(F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), joined.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return per.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
