"""The newest value at or before a row, without pairs and without a window over a whole group.

Rows that bring values and rows that ask for them form one table. It is cut into time
ranges of about equal size ("lots", contiguous in the order of group and time). A window
carries values forward inside a lot, and what a group brings into a lot is carried over
from the lots before, of which there is one row each. A group that holds half of all
rows is spread over half of the lots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.session import materialise


def _same(by: Sequence[str]) -> Column:
    condition = F.col("a._lot") == F.col("b._lot")
    for c in by:
        condition = condition & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return condition


def carry_forward(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], newest: Sequence[str] = (), sums: Sequence[str] = ()
) -> DataFrame:
    """The rows, with each column of ``newest`` and ``sums`` carried forward within ``by`` in the order ``order``.

    A ``newest`` column becomes its last value that isn't null, a ``sums`` column the sum
    so far, both up to and including the row. Null keys are a group, nulls in ``order``
    come first; rows equal in ``by`` and ``order`` are in no certain order.
    """
    lots = materialise(rows.repartitionByRange(*by, *order).withColumn("_lot", F.spark_partition_id()))
    at = F.struct(*order)
    totals = lots.groupBy(*by, "_lot").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in newest], *[F.sum(c).alias(c) for c in sums]
    )
    earlier = Window.partitionBy(*by).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    brought = totals.select(
        *by, "_lot", *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in newest],
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums],
    )
    inside = Window.partitionBy(*by, "_lot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = lots.withColumns({
        **{f"_{c}": F.last(c, ignorenulls=True).over(inside) for c in newest},
        **{f"_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums},
    })
    carried = [c for c in rows.columns if c not in (*newest, *sums)]
    return rolled.alias("a").join(brought.alias("b"), _same(by)).select(
        *[F.col(f"a.{c}") for c in carried],
        *[F.coalesce(f"a._{c}", f"b.{c}").alias(c) for c in newest],
        *[(F.col(f"a._{c}") + F.col(f"b.{c}")).alias(c) for c in sums],
    )


def latest_before(
    probes: DataFrame, events: DataFrame, by: Sequence[str], probe_time: str, event_time: str, tie: str, value: Column, name: str,
    probe_id: str = "id",
) -> DataFrame:
    """``probe_id`` and, as ``name``, the ``value`` of the newest event at or before each probe; null if there is none.

    Events of one time are told apart by ``tie``. One row per probe row.
    """
    tied = dict(events.dtypes)[tie]
    asked = probes.select(
        *by, F.col(probe_time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(tied).alias("_tie"), F.col(probe_id), F.lit(True).alias("_asks")
    )
    brought = events.select(
        *by, F.col(event_time).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(False).alias("_asks"), value.alias(name)
    )
    carried = carry_forward(
        asked.unionByName(brought, allowMissingColumns=True), by, ["_at", "_side", "_tie"], newest=[name]
    )
    return carried.where("_asks").select(probe_id, name)
