"""Points in intervals without pairing every point with every interval.

Time is cut into a hierarchy of blocks, each four times as long as the one below.
An interval is the disjoint union of a few dozen such blocks, and a point lies in
exactly one block per level, so "which intervals hold this point" is an equi-join
on the block. A pair meets in exactly one block, hence needs no recheck and no
de-duplication, and what is wanted about the intervals can be aggregated per block
before the join. Dense periods, long intervals and open ends cost no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blocks of 4**level microseconds.
DAY_LEVELS = 18  # the longest block inside a window of about a day
ALL_LEVELS = 27  # blocks of centuries, for intervals without an end
OPEN_END = 1 << 54


def micros(timestamp: Column) -> Column:
    return F.unix_micros(timestamp)


def interval_blocks(df: DataFrame, start: Column, end: Column, levels: int, keep: Sequence[Column | str]) -> DataFrame:
    """One row per block of the inclusive microsecond interval: ``keep, level, block``."""
    per_level = df.select(
        *keep, start.alias("_from"), (end + 1).alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    )

    def aligned(level: str) -> tuple[Column, Column]:
        up = F.expr(f"shiftright(_from + shiftleft(1L, 2 * ({level})) - 1, 2 * ({level}))")
        down = F.expr(f"shiftright(_to, 2 * ({level}))")
        return up, down

    (low, high), (low_above, high_above) = aligned("level"), aligned("level + 1")
    per_level = per_level.select(
        *[c for c in per_level.columns if c not in ("_from", "_to")],
        low.alias("_lo"), high.alias("_hi"),
        # The part that larger blocks cover; none on the top level.
        F.when(F.col("level") == levels, low).otherwise(low_above * 4).alias("_skip_lo"),
        F.when(F.col("level") == levels, low).otherwise(high_above * 4).alias("_skip_hi"),
    )
    covered = F.col("_skip_lo") < F.col("_skip_hi")

    def blocks(first: Column, after_last: Column) -> Column:
        return F.when(first < after_last, F.sequence(first, after_last - 1)).otherwise(F.array().cast("array<bigint>"))

    chosen = F.when(
        covered,
        F.concat(blocks(F.col("_lo"), F.col("_skip_lo")), blocks(F.col("_skip_hi"), F.col("_hi"))),
    ).otherwise(blocks(F.col("_lo"), F.col("_hi")))
    return per_level.select(
        *[c for c in per_level.columns if not c.startswith("_") and c != "level"],
        "level", F.explode(chosen).alias("block"),
    )


def point_blocks(df: DataFrame, point: Column, levels: int, keep: Sequence[Column | str]) -> DataFrame:
    """The block that holds a point, on every level: ``keep, level, block``."""
    return df.select(
        *keep, point.alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    ).withColumn("block", F.expr("shiftright(_at, 2 * level)")).drop("_at")
