"""Chat formatting by prefix-target expansion, in DataFrame functions.

Every assistant turn becomes an example of its own: all turns before it as
context, its reply as the only text under the loss mask (code points
[loss_start, loss_end) of the formatted text). Turns after the last reply, or a
conversation without reply, make one more example with an empty mask, so that no
turn is lost.

A turn is ``<s>[INST] role [/INST]text</s>``. Inside roles and texts a backslash
is doubled and one is put behind the first character of each control string;
dropping one backslash before any character undoes both.

An example holds its context by definition, so a row is as long as its
conversation up to that turn; conversations are spread by key.

Defined results: null texts and roles are empty; turns sort by number, then role
and text, nulls first, and repeated rows stay; rows without conversation id form
one conversation; an empty table gives an empty table. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, CLOSE, HEAD, TAIL):
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand_targets(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """conv_id, target (position of the reply, null if none), formatted, loss_start, loss_end."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = F.transform("t", lambda t: F.concat(F.lit(f"{OPEN}{HEAD} "), escaped(t.role), F.lit(f" {TAIL}")))
    convs = convs.select("conv_id", "t", head.alias("head"), F.transform("t", lambda t: escaped(t.text)).alias("body"))
    convs = convs.withColumn("whole", F.zip_with("head", "body", lambda a, b: F.concat(a, b, F.lit(CLOSE))))
    last = F.size("t") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(F.col("t"), i).role == target_role)
    rest = F.when(F.coalesce(F.element_at(F.col("t"), -1).role != target_role, F.lit(True)), F.array(F.struct(last.alias("upto"), F.lit(None).cast("int").alias("target"))))
    examples = F.concat(F.transform(targets, lambda i: F.struct(i.alias("upto"), i.alias("target"))), F.coalesce(rest, F.array().cast("array<struct<upto:int,target:int>>")))
    out = convs.withColumn("e", F.explode(examples))
    out = out.select("conv_id", F.col("e.target").alias("target"), F.concat_ws("", F.slice("whole", F.lit(1), F.col("e.upto") + 1)).alias("formatted"), F.length(F.get("body", F.col("e.target"))).alias("reply"))
    end = F.length("formatted") - len(CLOSE)
    return out.select("conv_id", "target", "formatted", F.coalesce(end - F.col("reply"), F.lit(0)).alias("loss_start"), F.when(F.col("reply").isNotNull(), end).otherwise(0).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, in order), loss_text, formatted_chars, parsed from the
    formatted examples alone: turns from the longest, replies from under the masks."""
    reply = unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    order = F.coalesce("target", F.lit(2**31 - 1))
    by_conv = examples.groupBy("conv_id").agg(
        F.max_by("formatted", order).alias("longest"),
        F.sort_array(F.collect_list(F.struct(order.alias("target"), F.when(F.col("target").isNotNull(), reply).otherwise("").alias("reply")))).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    start, sep = len(f"{OPEN}{HEAD} "), f" {TAIL}"

    def parsed(turn: Column) -> Column:
        role = F.substring_index(turn, sep, 1)
        return F.struct(unescaped(F.substr(role, F.lit(start + 1))).alias("role"), unescaped(F.substr(turn, F.length(role) + len(sep) + 1)).alias("text"))

    pieces = F.split("longest", CLOSE, -1)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parsed)
    return by_conv.select("conv_id", turns.alias("turns"), F.concat_ws("", F.transform("replies", lambda r: r.reply)).alias("loss_text"), "formatted_chars")
