"""Chat formatting: prefix-target expansion with a reversible template.

A turn is written ``### <role>:`` newline, the escaped text, ``</turn>`` newline. Backslashes, ``</turn>`` and
``### `` inside texts are escaped with a backslash, so a marker in the output is always a marker of the template
and the texts can be read back. Roles are percent-encoded.

Every assistant turn becomes an example of its own: all preceding turns are context, and only that reply (without
its markers) is trainable. Turns after the last reply, or a conversation without one, come as one more example
with nothing to train on, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE_ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("### "), F.lit("\\### "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), F.url_encode(role), F.lit(":\n"), escape(text), F.lit("</turn>\n"))


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: the examples of each conversation, numbered from 0.

    ``text`` is the formatted example; code points ``loss_start`` to ``loss_end`` (exclusive, from 0) are
    trainable, and the two are equal where nothing is. Rows are ordered by turn, then role and text; null turns
    come first, null roles and texts count as empty. Repeated rows are turns of their own. Rows with a null
    conv_id are one conversation. An empty table gives no rows. Other columns are ignored.
    """
    turns = conversations.select("conv_id", F.struct(
        F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("_t"))
    # a conversation is one unit: its examples hold all of its turns again and again
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    convs = convs.select("conv_id", "_t", F.transform("_t", lambda t: format_turn(t["role"], t["text"])).alias("_f"))
    n = F.size("_t")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("_t", i)["role"] == ROLE_ASSISTANT)
    convs = convs.withColumn("_ends", replies)
    tail = F.when(F.coalesce(F.try_element_at("_ends", F.lit(-1)), F.lit(0)) < n, F.array(n)).otherwise(
        F.array().cast("array<int>"))
    rows = convs.select("conv_id", "_t", "_f", F.posexplode(F.concat("_ends", tail)).alias("example", "_k"))
    role, reply = F.element_at("_t", F.col("_k"))["role"], F.element_at("_t", F.col("_k"))["text"]
    head = F.concat(F.array_join(F.slice("_f", 1, F.col("_k") - 1), ""),
                    F.lit("### "), F.url_encode(role), F.lit(":\n"))
    rows = rows.select("conv_id", "example", (role == ROLE_ASSISTANT).alias("_trains"), head.alias("_head"),
                       escape(reply).alias("_reply"))
    start = F.char_length("_head")
    end = start + F.char_length("_reply")
    return rows.select("conv_id", "example", F.concat("_head", "_reply", F.lit("</turn>\n")).alias("text"),
                       start.cast("long").alias("loss_start"),
                       F.when(F.col("_trains"), end).otherwise(start).cast("long").alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars`` from formatted examples alone.

    ``turns``: array of (role, text), unescaped, from the longest example; ``loss_text``: all text under the loss
    masks, in the order of the examples; ``formatted_chars``: length of all examples.
    """
    masked = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    got = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("_text"),
        F.array_sort(F.collect_list(F.struct("example", unescape(masked).alias("m")))).alias("_loss"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"))
    parts = F.filter(F.split("_text", "</turn>\n", -1), lambda p: p != "")
    one = lambda p: F.struct(
        F.url_decode(F.regexp_extract(p, r"^### ([^\n]*):\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"^### [^\n]*:\n", "")).alias("text"))
    return got.select("conv_id", F.transform(parts, one).alias("turns"),
                      F.array_join(F.transform("_loss", lambda x: x["m"]), "").alias("loss_text"), "formatted_chars")
