"""Chat formatting by relational means: collected turn structs, array functions, Spark expressions only.

Method
* Turns are collected as structs for each conversation and sorted by (turn, role, text).
* Adjacent turns of one role are merged into one block. Array functions find where blocks begin, slice the turns of
  each and join them; no accumulator is copied from turn to turn, so the work is linear in a conversation's length.
* A block is ``<|im_start|>role\\ntext<|im_next|>text<|im_end|>\\n``: the texts of a merged block stay apart, so that
  the turns as they were can be read back.
* Control strings within texts and roles are escaped: ``<`` + n backslashes + ``|`` gets one backslash more, and loses
  it again when read. No escaped text holds ``<|``. In roles a line feed is written as backslash, n (backslash: backslash, b).
* The loss mask has, for each turn, how many characters to skip, how many to take and whether they count for the loss.

Defined results: a null text or role is empty; rows of a null conv_id form one conversation; null turns come first, rows
that share a turn follow by role and text, and repeated rows are repeated turns; an empty table gives an empty result.
Columns besides conv_id, turn, role and text are not read. A conversation is one training example and so one string: it
must fit into a row (2 GB). Only a conversation's own turns meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_line(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role(line: Column) -> Column:
    return F.replace(F.replace(unescaped(line), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted string, mask array<struct<skip int, take int, loss boolean>>) of rows (conv_id, turn, role, text)."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    n = F.size("t")
    begins = lambda t, i: (i == 0) | (F.get(F.col("t"), i - 1)["role"] != t["role"])
    said = F.transform("t", lambda t, i: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text"), begins(t, i).alias("first"), i.alias("i")))
    rows = rows.select("conv_id", said.alias("t"))
    rows = rows.select("conv_id", "t", F.transform(F.filter("t", lambda t: t["first"]), lambda t: t["i"]).alias("at"))
    block = lambda i, j: F.concat(
        F.lit(START), _role_line(F.get(F.col("t"), i)["role"]), F.lit("\n"),
        F.array_join(F.transform(F.slice("t", i + 1, F.coalesce(F.get(F.col("at"), j + 1), n) - i), lambda t: t["text"]), NEXT), F.lit(END))
    head = lambda t: (F.when(t["first"], len(START) + 1 + F.char_length(_role_line(t["role"])) + F.when(t["i"] > 0, len(END)).otherwise(0))
                      .otherwise(len(NEXT)))
    run = lambda t: F.struct(head(t).cast("int").alias("skip"), F.char_length(t["text"]).alias("take"), (t["role"] == loss_role).alias("loss"))
    return rows.select("conv_id", F.array_join(F.transform("at", block), "").alias("formatted"), F.transform("t", run).alias("mask"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, chars long, turns array<struct<role, text>>, blocks int, loss array<string>): what the formatted strings and masks hold.

    ``loss`` has the texts under the mask. A mask that does not fit its string is an error.
    """
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2**31 - 1)
    rows = formatted.select("conv_id", "formatted", "mask", F.char_length("formatted").cast("long").alias("chars"), blocks.alias("b"))
    line = lambda b: F.substring_index(b, "\n", 1)
    body = lambda b: F.substr(b, F.char_length(line(b)) + 2, F.char_length(b) - F.char_length(line(b)) - 1 - len(END))
    texts = lambda b: F.transform(F.split(body(b), r"<\|im_next\|>", -1), lambda x: F.struct(_role(line(b)).alias("role"), x.alias("text")))
    rows = rows.select("conv_id", "chars", "mask", F.size("b").alias("blocks"), F.flatten(F.transform("b", texts)).alias("t"))
    fits = (F.size("t") == F.size("mask")) & F.forall(F.arrays_zip("t", "mask"), lambda z: F.char_length(z["t"]["text"]) == z["mask"]["take"])
    whole = F.aggregate("mask", F.lit(len(END)).cast("long"), lambda a, m: a + m["skip"] + m["take"]) == F.col("chars")
    checked = F.when(fits & whole, F.col("mask")).otherwise(F.raise_error(F.lit("a loss mask does not fit its conversation")).cast("array<struct<skip:int,take:int,loss:boolean>>"))
    rows = rows.select("conv_id", "chars", "blocks", "t", checked.alias("mask"))
    loss = F.transform(F.filter(F.arrays_zip("t", "mask"), lambda z: z["mask"]["loss"]), lambda z: unescaped(z["t"]["text"]))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), unescaped(x["text"]).alias("text")))
    return rows.select("conv_id", "chars", turns.alias("turns"), "blocks", loss.alias("loss"))


def loss_spans(mask: Column) -> Column:
    """array<struct<start, end>>: code points of the formatted string under the loss mask (end exclusive)."""
    ends = F.aggregate(mask, F.array().cast("array<struct<start:int,end:int,loss:boolean>>"), lambda a, m: F.concat(a, F.array(F.struct(
        (F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(0)) + m["skip"]).alias("start"),
        (F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(0)) + m["skip"] + m["take"]).alias("end"), m["loss"].alias("loss")))))
    return F.transform(F.filter(ends, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, as counts and hashes of what is read back from them."""
    read = read_conversations(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.col("chars").alias("formatted_chars"), F.col("blocks").cast("long").alias("n_blocks"))
