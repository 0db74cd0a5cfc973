"""Chat formatting with cumulative-snapshot collapse.

A chat service logs a conversation again after each exchange, so that one log is a prefix of the next. The hash of the
first k turns is the exclusive-or of the hashes of (place, role, text) of its turns, so prefix hashes roll along a
conversation and whole ones come from a plain aggregate. A conversation whose whole hash is a prefix hash of a longer
one is a snapshot and goes (anti-join); of equal conversations the smallest id stays. The rest is rendered.

Long conversations are never one task's work: turns are counted and hashed in segments of ``SEGMENT`` turn numbers,
segment totals give each segment its start, and the rendering is one row per segment.

Turns come in the order of (turn, role, text), nulls first; a repeated row counts as a turn of its own. A null role or text is
different from an empty one in the hash and rendered as empty. Rows without conversation id are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.llm import common

#: Turn numbers of one segment.
SEGMENT = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _running(partition: list[str], order: list[str], *columns: str) -> list:
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return [F.bit_xor(c).over(window).alias(c) for c in columns]


def turns_with_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its place in the conversation and the hash of the turns up to it (two 64-bit halves)."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")
    ).withColumn("segment", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / SEGMENT))
    ordered = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "text")
    rows = rows.withColumn("in_segment", F.row_number().over(ordered))
    sizes = rows.groupBy("conv_id", "segment").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "segment", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    placed = rows.join(starts, ["conv_id", "segment"]).withColumn("place", F.col("start") + F.col("in_segment"))

    def identity(salt: int):
        parts = [F.lit(salt), F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
        return F.xxhash64(*parts)

    hashed = placed.withColumns({"h1": identity(1), "h2": identity(2)})
    totals = hashed.groupBy("conv_id", "segment").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    offsets = totals.select("conv_id", "segment", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("h1", "h2")])
    inside = hashed.select("conv_id", "segment", "place", "role", "text", *_running(["conv_id", "segment"], ["place"], "h1", "h2"))
    return inside.join(offsets, ["conv_id", "segment"]).select(
        "conv_id", "segment", "place", "role", "text",
        F.col("h1").bitwiseXOR(F.col("h1_before")).alias("h1"), F.col("h2").bitwiseXOR(F.col("h2_before")).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """Conversations that are no prefix of a longer one, the smallest id of equal ones: conv_id, n_turns, n_equal."""
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("last")).select("conv_id", "last.*")
    whole = last.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    ends = last.select("conv_id", F.col("place").alias("n_turns"))
    inner = prefixes.select("conv_id", "place", "h1", "h2").join(ends, "conv_id").where("place < n_turns").select("place", "h1", "h2").distinct()
    return whole.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def collapsed_chats(turns: DataFrame, **columns: str) -> DataFrame:
    """Rendered maximal conversations, one row per segment: conv_id, segment (from 0), n_turns, n_equal, first_turn, rendered."""
    prefixes = common.stored(turns_with_prefixes(turns, **columns))
    kept = prefixes.join(maximal(prefixes), "conv_id")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    segments = kept.groupBy("conv_id", F.col("segment"), "n_turns", "n_equal").agg(
        F.min("place").alias("first_turn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("rendered"))
    return segments
