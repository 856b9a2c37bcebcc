"""Chat formatting after collapsing cumulative snapshots.

Loggers often store a conversation again after every turn. A conversation that is the beginning of a longer one, turn by
turn, says nothing of its own. A rolling hash per turn stands for the beginning up to that turn: the exclusive or of two
64-bit hashes of (place, role, text). Whole conversations are reduced to one per hash, then an anti-join against the
beginnings of others keeps the maximal ones, and only these are rendered. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The marks of the ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NO_ROLE = "unknown"


def turns_of(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``key`` (conversation), ``conv_id, turn, role, text``, repeated rows once."""
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(NO_ROLE)).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    alone = F.xxhash64("turn", "role", "text")
    return rows.distinct().withColumn("key", F.struct("conv_id", F.when(F.col("conv_id").isNull(), alone).alias("alone")))


def rendered(role: Column, text: Column) -> Column:
    """One turn. Marks inside a role or text are broken by a space, so that they cannot be taken for the layout."""

    def plain(value: Column) -> Column:
        return F.replace(F.replace(value, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))

    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE), F.lit("\n"))


def maximal_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies, chat``: the conversations that are not the beginning of a longer one, rendered. Of equal
    conversations the one with the smallest id stands for ``n_copies``.

    Turns are ordered by number, equal numbers by role and text; exactly repeated rows are one turn, and null numbers come
    first. A null role is ``unknown``, a null text empty. A row without ``conv_id`` is a conversation of one turn with a null
    id. Other columns are not read. Equal first turns of many conversations, or many copies of one, meet only as partial
    aggregates; the turns of one conversation meet in one task, because they become one text.
    """
    turns = turns_of(conversations, conv_id, turn, role, text)
    whole = Window.partitionBy("key")
    order = whole.orderBy("turn", "role", "text")
    placed = turns.withColumn("place", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashes = placed.select(
        "key",
        "place",
        F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("text", "place", F.lit(7), "role")).over(so_far).alias("h2"),
        F.count(F.lit(1)).over(whole).alias("n_turns"),
    )
    beginnings = hashes.where("place < n_turns").select("place", "h1", "h2").distinct()
    whole_ones = hashes.where("place = n_turns").groupBy("place", "h1", "h2").agg(F.min(F.struct(F.col("key.conv_id").isNull().alias("none"), "key"))["key"].alias("key"), F.count(F.lit(1)).alias("n_copies"))
    kept = whole_ones.join(beginnings, ["place", "h1", "h2"], "left_anti").select("key", F.col("place").cast("long").alias("n_turns"), "n_copies")
    lines = F.transform(F.sort_array("turns"), lambda t: rendered(t["role"], t["text"]))
    texts = turns.groupBy("key").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    same = kept.withColumnRenamed("key", "kept_key")
    return (
        texts.join(same, F.col("key").eqNullSafe(F.col("kept_key")))
        .select(F.col("key.conv_id").alias("conv_id"), "n_turns", "n_copies", F.array_join(lines, "").alias("chat"))
    )
