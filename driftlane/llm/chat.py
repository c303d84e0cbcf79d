"""Chat formatting with collapse of cumulative snapshots.

Loggers often store a conversation after every turn, so most stored ones are the
beginning of a longer one. The hash of a prefix is rolled along the turns; a
conversation whose whole hash is a proper prefix hash of another one is dropped by an
anti-join, and what remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlane.session import materialise

#: Turns of a block: no window and no rendered part sees more turns of a conversation.
BLOCK = 1024


def _ranked(conversations: DataFrame) -> DataFrame:
    """Turns with their rank ``n`` (from 0) in the conversation, counted over ranges of turn numbers first."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
        F.floor(F.col("turn") / BLOCK).alias("range"),  # null turns are a range before all others
    )
    counts = rows.groupBy("conv_id", "range").agg(F.count("*").alias("count"))
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")
    numbered = rows.withColumn("inside", F.row_number().over(inside) - 1)
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.range").eqNullSafe(F.col("b.range"))
    return numbered.alias("a").join(counts.alias("b"), same).select(
        "a.conv_id", (F.col("inside") + F.col("ahead")).alias("n"), "role", "text"
    )


def _sum_mod(column: str, window: Window | None = None):
    """A sum of 62-bit numbers that can't overflow: kept as a decimal, reduced afterwards."""
    total = F.sum(F.col(column).cast("decimal(20,0)"))
    return total.over(window) if window is not None else total


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """``conv_id, n, role, text, length, prefix``: the hash of the turns up to each turn.

    The hash of a prefix is the sum of its turns' hashes, each taken with its rank, so
    it rolls on by an addition and can be summed per block of turns first.
    """
    ranked = _ranked(conversations).withColumns({
        "block": F.floor(F.col("n") / BLOCK),
        "h1": F.shiftright(F.xxhash64("n", "role", "text"), 2), "h2": F.shiftright(F.xxhash64("text", "n", "role"), 2),
    })
    ranked = materialise(ranked)
    blocks = ranked.groupBy("conv_id", "block").agg(_sum_mod("h1").alias("s1"), _sum_mod("h2").alias("s2"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(20,0)")
    blocks = blocks.select(
        "conv_id", "block", F.coalesce(_sum_mod("s1", ahead), zero).alias("a1"),
        F.coalesce(_sum_mod("s2", ahead), zero).alias("a2"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rolled = ranked.withColumns({"r1": _sum_mod("h1", inside), "r2": _sum_mod("h2", inside)})
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.block") == F.col("b.block"))
    return rolled.alias("a").join(blocks.alias("b"), same).select(
        "a.conv_id", "n", "role", "text", "a.block",
        F.concat_ws(
            ":", (F.col("n") + 1).cast("string"), (F.col("r1") + F.col("a1")).cast("string"),
            (F.col("r2") + F.col("a2")).cast("string"),
        ).alias("prefix"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """The turns of conversations that are no beginning of another one; of equal ones the smallest id stays."""
    turns = materialise(prefix_hashes(conversations))
    ends = turns.groupBy("conv_id").agg(F.max(F.struct("n", "prefix")).alias("end")).select(
        "conv_id", F.col("end.prefix").alias("prefix"), (F.col("end.n") + 1).alias("n_turns")
    )
    same = F.col("t.conv_id").eqNullSafe(F.col("e.conv_id"))
    proper = turns.alias("t").join(ends.select("conv_id", F.col("n_turns").alias("length")).alias("e"), same).where(
        F.col("n") + 1 < F.col("length")
    ).select("t.prefix").distinct()
    # Without an id a conversation is the smallest.
    whole = ends.groupBy("prefix", "n_turns").agg(
        F.min(F.struct(F.col("conv_id").isNotNull().alias("named"), "conv_id")).alias("first"),
        F.count("*").alias("n_copies"),
    ).join(proper, "prefix", "left_anti").select(F.col("first.conv_id").alias("conv_id"), "n_turns", "n_copies")
    same = F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))
    return turns.alias("t").join(whole.alias("k"), same).select(
        "t.conv_id", "n_turns", "n_copies", "n", "role", "text", "block"
    )


def chat_texts(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as text: ``conv_id, part, n_turns, n_copies, text``.

    A turn is rendered as ``<|role|>`` and the text, each on its own line, closed by
    ``<|end|>``. A part holds up to 1,024 turns, so that a conversation of any length is
    written without one row holding it all; concatenated in order they are the whole.
    ``n_copies`` counts the equal conversations that this one stands for.

    Null roles and texts are empty ones; null turns come first; turns of equal number
    are ordered by role and text; repeated rows are repeated turns. Rows without a
    conversation id are one conversation. An empty table gives an empty result.
    """
    turns = maximal_conversations(conversations)
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    parts = turns.groupBy("conv_id", "n_turns", "n_copies", F.col("block").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines")
    )
    return parts.select(
        "conv_id", "part", "n_turns", "n_copies",
        F.array_join(F.transform("lines", lambda t: t["line"]), "").alias("text"),
    )
