"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one marked-up text; every assistant turn becomes an example whose context is the prefix of that
text before the reply and whose only trainable part is the reply. `examples()` explodes them, one row each; until then they are
offsets into the shared text, so what is shuffled grows with the turns and not with the sum of all prefixes. What is trained on is read back from the exploded
examples, regrouped by conversation in the order of their turns. Control strings
in texts are escaped reversibly: "~" becomes "~0", then "<|" becomes "<~1|"; roles also turn a line feed into "~2".

Null text or role counts as empty. Rows of equal turn are ordered by role, then text; repeated rows are kept; rows of a
null conv_id form one conversation. A conversation without an assistant turn has no example. A conversation is one row of
the output by contract, so its turns meet in one task; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(x: Column, role: bool = False) -> Column:
    x = F.replace(F.replace(x, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1|"))
    return F.replace(x, F.lit("\n"), F.lit("~2")) if role else x


def unescape(x: Column, role: bool = False) -> Column:
    x = F.replace(x, F.lit("~2"), F.lit("\n")) if role else x
    return F.replace(F.replace(x, F.lit("<~1|"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, examples: array of (turn, context_chars, loss_start, loss_chars), offsets in code points."""
    rows = rows.select("conv_id", F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    head = F.concat(F.lit(START), escape(F.col("_role"), True), F.lit("\n"))
    rows = rows.select("conv_id", "_turn", "_role", "_text", head.alias("_head"), escape(F.col("_text")).alias("_body"))
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    size = F.length("_head") + F.length("_body") + len(END)
    rows = rows.select("conv_id", "_role", F.concat("_head", "_body", F.lit(END)).alias("_piece"), F.row_number().over(order).alias("_no"),
                       (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("_head")).alias("_at"), F.length("_body").cast("long").alias("_chars"))
    turn = F.struct(F.col("_no"), F.col("_piece"), F.when(F.col("_role") == "assistant", F.struct(F.col("_no").alias("turn"), F.col("_at").alias("context_chars"), F.col("_at").alias("loss_start"),
                                                                                              F.col("_chars").alias("loss_chars"))).alias("example"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return out.select("conv_id", F.array_join(F.transform("_turns", lambda t: t["_piece"]), "").alias("formatted"),
                      F.filter(F.transform("_turns", lambda t: t["example"]), lambda e: e.isNotNull()).alias("examples"))


def examples(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, context, target: one row for each assistant turn, as strings."""
    rows = formatted.select("conv_id", "formatted", F.explode("examples").alias("e"))
    return rows.select("conv_id", F.col("e.turn").alias("turn"), F.substring("formatted", F.lit(1), F.col("e.context_chars").cast("int")).alias("context"),
                       F.substring("formatted", (F.col("e.loss_start") + 1).cast("int"), F.col("e.loss_chars").cast("int")).alias("target"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss (text under the loss masks of its examples), formatted_chars, all from the output alone."""
    marked = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")

    def parse(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(START) + 1), cut - len(START) - 1)
        text = F.substring(piece, cut + 1, F.length(piece))
        return F.struct(unescape(role, True).alias("role"), unescape(text).alias("text"))

    replies = examples(formatted).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "target"))).alias("_replies"))
    loss = F.array_join(F.transform(F.coalesce("_replies", F.array().cast("array<struct<turn: int, target: string>>")), lambda r: unescape(r["target"])), "")
    whole = formatted.select(F.col("conv_id").alias("_conv"), F.transform(marked, parse).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = whole.join(replies, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("_conv").alias("conv_id"), "turns", loss.alias("loss"), "formatted_chars")
