"""Chat formatting with DataFrame expressions only.

Turns are collected per conversation as structs and sorted; adjacent turns of one role become one
block with array functions, and the block texts are joined into

    ### role: text <next> text </turn>\\n

Inside roles and texts, backslash, # and < (and : in roles) get a backslash in front, so a control
string can't occur in them and every conversation can be read back exactly. The loss mask is
the list of the formatted string's segments in order, each with a flag: the escaped texts of the
loss role are under the mask, all else isn't. Nothing adds up offsets, so the work grows with
the length of a conversation, not with its square.

Defined cases: a null text is empty, a null role is the empty role; turns that share a number are
ordered by role, then text; null turn numbers come first; repeated rows are turns of their own; a
null conversation id is a conversation; an empty table gives no rows; other columns are ignored.
roles, texts and conversations may be of any length. A conversation becomes one string, so its turns
meet in one row, as they must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

HEAD, COLON, NEXT, END = "### ", ": ", " <next> ", " </turn>\n"


def escape(text: Column, chars: str = r"\\#<") -> Column:
    return F.regexp_replace(text, f"([{chars}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>, which make up formatted."""
    turns = df.select(
        C.col(conv_col).alias("conv_id"),
        F.struct(C.col(turn_col).alias("turn"), F.coalesce(C.col(role_col), F.lit("")).alias("role"), F.coalesce(C.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # A block starts at each turn whose role differs from the one before.
    starts = sorted_turns.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])))

    def block(start: Column, k: Column) -> Column:
        last = F.when(k + 1 < F.size("starts"), F.element_at("starts", F.least(k + 2, F.size("starts")))).otherwise(F.size("turns") + 1)
        merged = F.slice("turns", start, last - start)
        return F.struct(
            F.element_at("turns", start)["role"].alias("role"),
            F.concat(F.lit(HEAD), escape(F.element_at("turns", start)["role"], r"\\#<:"), F.lit(COLON)).alias("head"),
            F.transform(merged, lambda t: escape(t["text"])).alias("texts"),
        )

    blocks = starts.select("conv_id", F.transform("starts", block).alias("blocks"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(b: Column) -> Column:
        no, loss = F.lit(False), b["role"] == loss_role
        texts = F.transform(b["texts"], lambda t, i: F.when(i == 0, F.array(segment(t, loss))).otherwise(F.array(segment(F.lit(NEXT), no), segment(t, loss))))
        return F.concat(F.array(segment(b["head"], no)), F.flatten(texts), F.array(segment(F.lit(END), no)))

    parts = blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return parts.select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text: what the formatted text and its segments under the mask hold."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")
    pattern = r"(?s)^### ((?:[^\\:]++|\\.)*+): (.*)$"  # possessive: a long role takes no stack

    def turns_of(b: Column) -> Column:
        role = unescape(F.regexp_extract(b, pattern, 1))
        return F.transform(F.split(F.regexp_extract(b, pattern, 2), NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), loss.alias("loss_text"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
