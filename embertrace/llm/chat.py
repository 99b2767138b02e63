"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A chat service that logs the whole conversation after each turn leaves many conversations that are the
beginning of longer ones. Each turn gets a rolling hash of all turns up to it. A conversation whose last
hash occurs before the end of a longer one is its snapshot and goes; of equal conversations the one of the
lowest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PREFIX = ("pos", "x1", "x2")


def rolling(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, x1, x2): for each turn its place, the conversation's length and the hash of all
    turns up to it. A place enters the hash of its turn, so the exclusive or of turns keeps their order."""
    order = Window.partitionBy("conv_id").orderBy("turn", "h1", "h2")
    whole = Window.partitionBy("conv_id").orderBy("turn", "h1", "h2").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = turns.select("conv_id", F.row_number().over(order).alias("pos"), F.count("*").over(whole).alias("n"), "turn", "h1", "h2")
    mixed = placed.withColumns({"m1": F.xxhash64("pos", "h1"), "m2": F.xxhash64("h2", "pos")})
    return mixed.select("conv_id", "pos", "n", F.bit_xor("m1").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("x1"),
                        F.bit_xor("m2").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("x2"))


def hashed(turns: DataFrame) -> DataFrame:
    """Turns of conversations that have an id, with two hashes of role and text (null apart from empty)."""
    content = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", F.xxhash64(F.lit(1), *content).alias("h1"), F.xxhash64(*content, F.lit(2)).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that are not the beginning of a longer one, one of each
    group of equal ones, with the group's size."""
    prefixes = rolling(hashed(turns).select("conv_id", "turn", "h1", "h2").distinct())
    full = prefixes.where("pos = n").groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = prefixes.where("pos < n").select(*PREFIX).distinct()
    return full.join(inner, list(PREFIX), "left_anti").select("conv_id", F.col("pos").cast("bigint").alias("n_turns"), "copies")


def plain(text: Column) -> Column:
    """Text in which the template's own marks cannot be mistaken for marks."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(START), F.lit("< |im_start|>")), F.lit(END), F.lit("< |im_end|>"))


def without_conversation(turns: DataFrame) -> DataFrame:
    """The turns that name no conversation, which ``render`` leaves out; all columns."""
    return turns.where("conv_id IS NULL")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, rendered) of the maximal conversations among ``turns`` (conv_id, turn, role, text), with
    n_turns and copies.

    Turns stand in order of turn number; turns of one number in order of their hashes. A turn logged twice
    (equal in all four columns) counts once. A null role renders as ``user``, a null text as empty; both
    differ from given ones in comparison. Turns of a null conv_id belong to no conversation and are left out;
    ``without_conversation`` has them. Empty tables give no rows. Other
    columns are ignored. A rendered conversation is one row, so it must fit one.
    """
    kept = maximal(turns)
    chosen = hashed(turns).distinct().join(kept, "conv_id")
    piece = F.concat(F.lit(START), plain(F.coalesce("role", F.lit("user"))), F.lit("\n"), plain(F.col("text")), F.lit(END + "\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "h1", "h2", piece.alias("piece"))))
    return chosen.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), ordered.alias("pieces")).select(
        "conv_id", "n_turns", "copies", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"))
