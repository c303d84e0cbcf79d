"""Windows that are reported once they are closed and reported again when late rows arrive.

Every batch adds its counts per model and slide to a table. That table is all a window is
made of, so a closed window that late rows touch is added up again from the slides of its
own days, exactly, and replaces what was reported. The rows that were late go to a side
table. A repeated batch replaces its own files; none of it needs streaming state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from driftlane import config as C
from driftlane.functions.metrics import confusion, precision_recall_f1

# Microseconds, so that times pass the driver unchanged.
_CLOCK = "newest bigint, closed_until bigint"
_KEYS = ["model_id", "window_start", "window_end"]


def _micros(duration: str) -> int:
    return pd.Timedelta(duration).value // 1000


def _time(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros))


def _windows(panes: DataFrame, window: str, slide: str) -> DataFrame:
    """Each slide once per window that holds it."""
    return panes.withColumn("_w", F.window("pane", window, slide)).select(
        "*", F.col("_w")["start"].alias("window_start"), F.col("_w")["end"].alias("window_end")
    ).drop("_w")


def _recounted(
    spark: SparkSession, folder: str, schema: str, touched: DataFrame, before: int | None, until: int, window: str, slide: str
) -> DataFrame:
    """Windows closed since ``before``, and closed ones in ``touched``, added up from the stored slides of their days."""
    # The days that late rows touch are few; the closed range is read by its ends.
    days = {r["day"] for r in touched.select(
        F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))).alias("day")
    ).distinct().collect()}
    panes = spark.read.schema(schema).parquet(f"{folder}/panes")
    recent = F.col("dt") <= F.to_date(_time(until))
    if before is not None:
        recent = recent & (F.col("dt") >= F.to_date(_time(before - _micros(window))))
    wanted = recent | F.col("dt").isin(*days) if days else recent
    in_windows = _windows(panes.where(wanted), window, slide)
    closed = in_windows.where(F.col("window_end") <= _time(until))
    marked = closed.join(touched.withColumn("corrected", F.lit(True)), _KEYS, "left")
    new = F.lit(True) if before is None else F.col("window_end") > _time(before)
    names = [c for c in panes.columns if c not in ("model_id", "pane", "dt", "batch")]
    return marked.where(new | F.col("corrected")).groupBy(*_KEYS).agg(
        *[F.sum(c).alias(c) for c in names], F.coalesce(F.max("corrected"), F.lit(False)).alias("corrected")
    )


def corrected_windows(
    labelled: DataFrame, folder: str, window: str = "24 hours", slide: str | None = None, lateness: str = "10 minutes"
) -> DataStreamWriter:
    """Confusion counts per model and window from a stream of labelled rows (``model_id, created_at, prediction, true_label``).

    A window is closed when the newest row is ``lateness`` past its end. Tables in
    ``folder``: ``reports`` (one version of a window per batch that closed or corrected it),
    ``late`` (rows of closed windows), ``panes`` (counts per slide, by day) and ``clock``.
    Null times count nowhere.
    """
    slide = slide or window
    if pd.Timedelta(window) % pd.Timedelta(slide) != pd.Timedelta(0):
        raise ValueError("the window must be a whole number of slides")

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Read several times below; a join of streams shouldn't run for each.
        batch = batch.persist()
        try:
            report(batch, batch_id)
        finally:
            batch.unpersist()

    def report(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            before = spark.read.schema(_CLOCK).parquet(f"{folder}/clock/batch={batch_id - 1}").first()
        closed = before["closed_until"] if before else None
        rows = batch.where(F.col("created_at").isNotNull()).withColumn("_w", F.window("created_at", slide))
        counts = rows.groupBy("model_id", F.col("_w.start").alias("pane")).agg(*confusion())
        dated = counts.withColumns({"dt": F.to_date("pane"), "batch": F.lit(batch_id)})
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(f"{folder}/panes")
        is_late = F.lit(False) if closed is None else F.col("_w.end") <= _time(closed)
        rows.where(is_late).drop("_w").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")

        newest = rows.agg(F.max(F.unix_micros("created_at"))).first()[0]
        newest = max((t for t in (newest, before and before["newest"]) if t is not None), default=None)
        until = None if newest is None else newest - _micros(lateness)
        spark.createDataFrame([(newest, until)], _CLOCK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/clock/batch={batch_id}")
        if until is None:
            return
        touched = _windows(counts.select("model_id", "pane"), window, slide).select(*_KEYS).distinct()
        touched = touched.where(F.lit(False) if closed is None else F.col("window_end") <= _time(closed))
        schema = f"{_ddl(counts)}, dt date, batch bigint"
        _recounted(spark, folder, schema, touched, closed, until, window, slide).write.mode("overwrite").parquet(
            f"{folder}/reports/batch={batch_id}"
        )

    return labelled.writeStream.foreachBatch(handle)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def corrected_report(spark: SparkSession, folder: str, minimum: int = C.MIN_ACCURACY_SAMPLES) -> DataFrame:
    """The newest version of every window: metrics, and whether late rows have changed it."""
    versions = spark.read.parquet(f"{folder}/reports")
    values = [c for c in versions.columns if c not in (*_KEYS, "batch", "corrected")]
    newest = versions.groupBy(*_KEYS).agg(
        F.max_by(F.struct(*values), "batch").alias("v"), F.max("corrected").alias("corrected")
    ).select(*_KEYS, "v.*", "corrected")
    metrics = precision_recall_f1(newest).where(F.col("n_samples") >= minimum)
    return metrics.select(
        *_KEYS, "n_samples", *[F.round(m, 4).alias(m) for m in ("precision", "recall", "f1")], "corrected"
    )


def late_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The side table: rows that came after a window that holds them was closed."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/late")
