"""Exact order statistics without sorting or collecting a group.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a group is narrowed by histograms instead: a coarse pass counts values per
logarithmic bucket, and only the buckets that hold a wanted rank are looked at
again, more finely. Every pass is a partial aggregation over a pruned scan, so a
group with a third of all rows costs no more than any other, and each window
below sees at most one histogram, never the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.session import materialise

_PER_OCTAVE = 512
_SUBDIVISIONS = 1 << 18


def _coarse(value: Column) -> Column:
    """Monotone bucket number, about 512 buckets for each doubling of the value."""
    magnitude = F.floor(F.log2(F.abs(value) * 1048576.0 + 1.0) * _PER_OCTAVE)
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def _fine(value: Column, low: Column, high: Column) -> Column:
    return F.floor((value - low) / (high - low) * _SUBDIVISIONS)


def _holding_ranks(histogram: DataFrame, keys: list[str], order: str, start: Column, ranks: Callable) -> DataFrame:
    """Histogram rows that hold a wanted rank, with the count of values before them."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    running = F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = histogram.withColumn("_before", start + running - F.col("_n"))
    return placed.withColumn("_ranks", ranks(placed)).filter(F.size("_ranks") > 0)


def _within(ranks: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))


def values_at_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
) -> DataFrame:
    """The exact values at zero-based ranks of each group.

    ``ranks`` maps the group's row count to an array of ranks. Null and NaN values
    are left out. ``rows`` is read up to three times, so it should be a scan or a
    stored table. Returns ``keys, total, rank, value``, one row per group and rank,
    from stored files whose size Spark knows when it is joined.
    """
    keys = list(keys)
    source = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    source = source.withColumn("_coarse", _coarse(F.col("_v")))

    histogram = source.groupBy(*keys, "_coarse").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    histogram = histogram.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    first = materialise(
        _holding_ranks(histogram, keys, "_coarse", F.lit(0), lambda _: _within(ranks(F.col("_total"))))
    )
    found, open_rows = _settle(first, keys)
    if not open_rows:
        return found

    # Second pass: subdivide the buckets that still hold several distinct values.
    narrow = first.filter("_low < _high").select(
        *keys, "_coarse", F.col("_low").alias("_lo1"), F.col("_high").alias("_hi1"),
        F.col("_before").alias("_b1"), F.col("_ranks").alias("_r1"), "_total",
    )
    inside = source.join(narrow, [*keys, "_coarse"]).withColumn(
        "_fine", _fine(F.col("_v"), F.col("_lo1"), F.col("_hi1"))
    )
    histogram = inside.groupBy(*keys, "_coarse", "_fine").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        F.first("_b1").alias("_b1"), F.first("_r1").alias("_r1"), F.first("_total").alias("_total"),
    )
    second = materialise(
        _holding_ranks(histogram, [*keys, "_coarse"], "_fine", F.col("_b1"), lambda _: _within(F.col("_r1")))
    )
    more, open_rows = _settle(second, keys)
    found = found.unionByName(more)
    if not open_rows:
        return found

    # Last pass: what is left spans so few representable numbers that counting
    # each distinct value stays small whatever the data.
    narrow = second.filter("_low < _high").select(
        *keys, "_coarse", "_fine", F.col("_low").alias("_lo2"), F.col("_high").alias("_hi2"),
        F.col("_before").alias("_b2"), F.col("_ranks").alias("_r2"), "_total",
    )
    inside = source.join(narrow, [*keys, "_coarse"]).filter(F.col("_v").between(F.col("_lo2"), F.col("_hi2")))
    histogram = inside.groupBy(*keys, "_coarse", "_fine", "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_b2").alias("_b2"),
        F.first("_r2").alias("_r2"), F.first("_total").alias("_total"),
    ).withColumn("_low", F.col("_v")).withColumn("_high", F.col("_v"))
    third = materialise(
        _holding_ranks(histogram, [*keys, "_coarse", "_fine"], "_v", F.col("_b2"), lambda _: _within(F.col("_r2")))
    )
    return found.unionByName(_explode_ranks(third, keys))


def _explode_ranks(settled: DataFrame, keys: list[str]) -> DataFrame:
    return settled.select(
        *keys, F.col("_total").alias("total"), F.explode("_ranks").alias("rank"), F.col("_low").alias("value")
    )


def _settle(candidates: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Ranks already pinned to one value, and how many buckets are still open."""
    open_rows = candidates.filter("_low < _high").count()
    return _explode_ranks(candidates.filter("_low = _high"), keys), open_rows


def _bracketing_ranks(total: Column, probabilities: Sequence[float]) -> Column:
    positions = [(total - 1) * F.lit(float(p)) for p in probabilities]
    return F.array_distinct(
        F.array(*[f(p).cast("bigint") for p in positions for f in (F.floor, F.ceil)])
    )


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], name: str = "quantiles"
) -> DataFrame:
    """Exact quantiles with linear interpolation; ``keys, n, <name> array<double>``."""
    picked = values_at_ranks(rows, keys, value, lambda total: _bracketing_ranks(total, probabilities))
    # At most two entries per probability, so the map is bounded by the request.
    by_group = picked.groupBy(*keys).agg(
        F.first("total").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"),
    )
    results = []
    for p in probabilities:
        position = (F.col("n") - 1) * F.lit(float(p))
        low = F.element_at("_at", F.floor(position).cast("bigint"))
        high = F.element_at("_at", F.ceil(position).cast("bigint"))
        results.append(low + (high - low) * (position - F.floor(position)))
    return by_group.select(*keys, "n", F.array(*results).alias(name))
