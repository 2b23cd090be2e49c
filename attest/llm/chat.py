"""Training examples of conversations by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its reply is trainable.
The examples of a conversation are prefixes of one formatted text. That text is gathered once, from one piece per turn with
its place, and every prefix is written out from it in the same task. So what is shuffled grows with the turns, and only
the examples themselves grow with their square.

A turn is `<|turn|>` role `<|text|>` text `<|end|>`. Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`,
so no text holds a mark, and `turns_of` gives back what was formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
REPLY = "assistant"
# Turns are summed up in blocks of so many turn numbers, and then over the blocks of a conversation.
BLOCK_TURNS = 1024


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def formatted_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """(conv_id, block, turn, role, text, piece, start, size, text_start, text_size, turns_before, replies_before) per row.

    `piece` is the formatted turn; it lies at code points start to start + size of its conversation's text, and the escaped
    text at text_start to text_start + text_size. Rows of a conversation are in the order of turn (a whole number; null
    last), role and text; equal rows are told apart by nothing, so any order of them gives the same text. A null role or
    text is empty, a null conv_id is a conversation like others. An empty table gives no rows; extra columns are not read.

    Places are running sums inside blocks of BLOCK_TURNS turn numbers, and then over the blocks, so that a long
    conversation is spread over tasks; only the rows of one block, or of one turn number, are sorted in one task.
    """
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                        filled(role).alias("role"), filled(text).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit((1 << 63) - 1)))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.withColumns({"head": F.length(head).cast("long"), "body": escaped(F.col("text"))})
    rows = rows.withColumns({"piece": F.concat(head, "body", F.lit(END)), "text_size": F.length("body").cast("long"),
                             "reply": (F.col("role") == REPLY).cast("long")})
    rows = rows.withColumn("size", F.length("piece").cast("long"))
    sums = {"start": F.col("size"), "turns_before": F.lit(1), "replies_before": F.col("reply")}
    rows = rows.withColumn("of", F.struct("conv_id"))  # equal to itself where the id is null
    blocks = rows.groupBy("of", "block").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("of", "block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums])
    inside = Window.partitionBy("of", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(starts, ["of", "block"])
    at = lambda n: (F.col(n) + F.col(f"before_{n}")).alias(n)
    return placed.select("conv_id", "block", "turn", "role", "text", "piece", at("start"), "size",
                         (F.col("start") + F.col("before_start") + F.col("head")).alias("text_start"), "text_size",
                         at("turns_before"), at("replies_before"))


def whole_conversations(placed: DataFrame) -> DataFrame:
    """(conv_id, formatted, ends) per conversation from the rows of `formatted_turns`: its whole text, and of each example
    its number, turns, size in code points, the place of the one text that is trainable, and the formatted reply."""
    part = F.struct("start", "piece", (F.col("role") == REPLY).alias("is_reply"), F.col("replies_before").alias("example"),
                    (F.col("turns_before") + 1).alias("n_turns"), (F.col("start") + F.col("size")).alias("chars"),
                    F.col("text_start").alias("loss_start"), F.col("text_size").alias("loss_size"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    end = lambda p: F.struct(*[p[n].alias(n) for n in ("example", "n_turns", "chars", "loss_start", "loss_size")], p["piece"].alias("reply"))
    return grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
                          F.transform(F.filter("parts", lambda p: p["is_reply"]), end).alias("ends"))


def examples(placed: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, chars, loss_start, loss_size, reply, text) from the rows of `formatted_turns`.

    One row per assistant turn, numbered from 0 in its conversation. `text` is the whole example, the first `chars` code
    points of the conversation's text; it ends with `reply`, the formatted turn. loss_start and loss_size are the code points
    in it of the one text that is trainable. A conversation without an assistant turn has no example. The result grows with
    the square of a conversation's turns, as its examples do.
    """
    cut = whole_conversations(placed).select("conv_id", "formatted", F.explode("ends").alias("e"))
    return cut.select("conv_id", "e.*", F.substr("formatted", F.lit(1), F.col("e.chars").cast("int")).alias("text"))


def example_texts(placed: DataFrame) -> DataFrame:
    """`examples` without the reply on its own."""
    return examples(placed).drop("reply")


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text consists of, in order."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescaped(F.substring_index(p, TEXT, -1)).alias("text")))


def conversations_back(placed: DataFrame) -> DataFrame:
    """(conv_id, turns, losses, chars) per conversation, read back from the texts of its examples.

    `losses` are the texts under the masks of all examples, in order and without escapes, each cut out of its example's text.
    `turns` (role, text) are parsed from the last example, which holds all others, and from what follows it: the turns after
    the last reply are in no example. `chars` counts the code points of all these texts. A conversation is gathered into one
    row, as a digest over all of it needs; its examples are written out and read back one by one in the same task.
    """
    place = lambda p: F.struct(p["example"].alias("example"), F.lit(0).cast("bigint").alias("begin"), p["chars"].alias("chars"),
                               p["loss_start"].alias("loss_start"), p["loss_size"].alias("loss_size"))
    none = F.lit(None).cast("bigint")
    begin = F.when(F.size("ends") > 0, F.element_at("ends", -1)["chars"]).otherwise(F.lit(0).cast("bigint"))
    rest = F.struct(none.alias("example"), begin.alias("begin"), F.length("formatted").cast("bigint").alias("chars"),
                    none.alias("loss_start"), none.alias("loss_size"))
    cut = whole_conversations(placed).select("conv_id", "formatted", F.size("ends").cast("bigint").alias("n"),
                                             F.explode(F.concat(F.transform("ends", place), F.array(rest))).alias("e"))
    text = F.substr("formatted", (F.col("e.begin") + 1).cast("int"), (F.col("e.chars") - F.col("e.begin")).cast("int"))
    shown = cut.select("conv_id", "e.example", "n", text.alias("text"), "e.loss_start", "e.loss_size")
    loss = unescaped(F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_size").cast("int")))
    last = F.col("example").isNull() | (F.col("example") == F.col("n") - 1)
    read = shown.select("conv_id", F.length("text").cast("bigint").alias("chars"),
                        F.when(F.col("example").isNotNull(), F.struct("example", loss.alias("text"))).alias("loss"),
                        F.when(last, F.struct(F.coalesce("example", "n").alias("example"), turns_of(F.col("text")).alias("turns"))).alias("part"))
    grouped = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.array_sort(F.collect_list("loss")).alias("losses"),
                                          F.sum("chars").alias("chars"))
    return grouped.select("conv_id", F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"),
                          F.transform("losses", lambda e: e["text"]).alias("losses"), "chars")
