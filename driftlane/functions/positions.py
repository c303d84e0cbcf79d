"""Positions in order, spread over many tasks however large a group is.

A window over a whole group sorts it in one task. Here rows are dealt into contiguous
ranges of the order first ("lots"); a window numbers the rows of one group in one lot,
and the counts of the lots before give the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.session import materialise

#: Tells repeated rows apart, so that ranges can be cut between them.
SALT = "row_salt"


def salted(rows: DataFrame) -> DataFrame:
    """To be put on rows as they are read: there it is the same again when a task is repeated."""
    return rows.withColumn(SALT, F.monotonically_increasing_id())


def in_lots(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, stored, with the number of their ``lot``: lots follow each other in the order ``by``, ``order``."""
    return materialise(rows.repartitionByRange(*by, *order).withColumn("lot", F.spark_partition_id()))


def lot_offsets(lots: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group and lot: ``by, lot, ahead`` (rows in earlier lots) and ``total`` (rows of the group)."""
    counts = lots.groupBy(*by, "lot").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy(*by).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by).orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        *by, "lot", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("ahead"), F.sum("here").over(everything).alias("total")
    )


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equality of the columns of two aliases; null equals null."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def numbered(lots: DataFrame, offsets: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The rows with their position ``name`` in the group, from 0, and what else ``offsets`` has."""
    inside = Window.partitionBy(*by, "lot").orderBy(*order)
    placed = lots.withColumn("inside", F.row_number().over(inside) - 1)
    added = [c for c in offsets.columns if c not in (*by, "lot", "ahead", "total")]
    return placed.alias("a").join(offsets.alias("b"), same("a", "b", [*by, "lot"])).select(
        *[F.col(f"a.{c}") for c in lots.columns], (F.col("inside") + F.col("ahead")).cast("bigint").alias(name),
        *[F.col(f"b.{c}") for c in added],
    )


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The rows with their position ``name`` within ``by`` in the order ``order`` (nulls first), from 0, and their ``lot``."""
    lots = in_lots(rows, by, order)
    return numbered(lots, lot_offsets(lots, by), by, order, name)
