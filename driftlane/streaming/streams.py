"""The same analytics over streams of telemetry.

Watermarks bound how long state is kept; what arrives later is left to the batch
jobs, which recount a whole window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from driftlane import config as C
from driftlane.functions import psi
from driftlane.functions.ids import model_name
from driftlane.functions.metrics import confusion, precision_recall_f1
from driftlane.operators import drift, incidents

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- delayed labels ---------------------------------------------------------------


def delayed_labels(
    predictions: DataFrame,
    outcomes: DataFrame,
    max_delay: str = "3000 seconds",
    lateness: str = "10 minutes",
    keep_unlabelled: bool = False,
) -> DataFrame:
    """Joins labels that arrive at most ``max_delay`` after their prediction.

    State is dropped once no label can come any more. ``keep_unlabelled`` then emits
    the prediction with a null label, as one that was never labelled.
    """
    p = predictions.withWatermark("created_at", lateness)
    o = outcomes.select("prediction_id", "true_label", "observed_at").withWatermark("observed_at", lateness)
    in_time = (F.col("observed_at") >= F.col("created_at")) & (
        F.col("observed_at") <= F.col("created_at") + F.expr(f"INTERVAL {max_delay}")
    )
    return p.join(o, (p["id"] == o["prediction_id"]) & in_time, "left_outer" if keep_unlabelled else "inner")


def sliding_confusion(
    labelled: DataFrame, window: str = "24 hours", slide: str = "6 hours", minimum: int = C.MIN_ACCURACY_SAMPLES
) -> DataFrame:
    """Precision, recall and F1 per model and sliding window, once the window is closed.

    A row is counted once, in its slide; closed slides are then added up to windows. So
    the state has a row per model and slide, however many windows hold one. Windows are
    whole numbers of slides.
    """
    if pd.Timedelta(window) % pd.Timedelta(slide) != pd.Timedelta(0):
        raise ValueError("the window must be a whole number of slides")
    panes = labelled.groupBy(F.window("created_at", slide).alias("pane"), "model_id").agg(*confusion())
    names = [c for c in panes.columns if c not in ("pane", "model_id")]
    counts = panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"), "model_id").agg(
        *[F.sum(c).alias(c) for c in names]
    )
    metrics = precision_recall_f1(counts).filter(F.col("n_samples") >= minimum)
    return metrics.select(
        "model_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_samples",
        *[F.round(m, 4).alias(m) for m in ("precision", "recall", "f1")],
    )


# --- drift and volume ---------------------------------------------------------------


def window_bins(rows: DataFrame, edges: DataFrame, window: str, lateness: str) -> DataFrame:
    """Bin counts per model, feature and tumbling window, each emitted once when closed.

    ``rows`` are long rows with ``created_at``; ``edges`` is a stored baseline table.
    """
    late = rows.withWatermark("created_at", lateness)
    binned = drift._binned(late, edges)
    return binned.groupBy(
        F.window("created_at", window).alias("w"), "model_id", "feature", "bin", "category"
    ).agg(F.count(F.lit(1)).alias("actual"))


def window_drift(bins: DataFrame, expected: DataFrame, minimum: int = C.MIN_DRIFT_SAMPLES) -> DataFrame:
    """Drift per closed window from its bin counts (a batch of ``window_bins``)."""
    counts = bins.select(
        F.col("w.start").alias("window_start"), "model_id", "feature", "bin", "category", F.lit(0.0).alias("expected"), "actual"
    )
    windows = counts.filter(F.col("feature") == "_rows").select(
        "window_start", "model_id", F.col("actual").alias("sample_size")
    )
    wanted = expected.join(windows.select("window_start", "model_id"), "model_id").select(
        "window_start", "model_id", "feature", "bin", "category", "expected", F.lit(0).cast("bigint").alias("actual")
    )
    keys = ["window_start", "model_id", "feature"]
    both = counts.filter(F.col("feature") != "_rows").unionByName(wanted).groupBy(*keys, "bin", "category").agg(
        F.sum("expected").alias("expected"), F.sum("actual").alias("actual")
    )
    scored = psi.psi_by_group(both, keys, extra=[F.sum("expected").alias("mass")]).filter("mass > 0")
    return scored.join(windows, ["window_start", "model_id"]).select(
        "window_start", "model_id", F.col("feature").alias("feature_name"), "psi_score", "sample_size",
        psi.classify(F.col("psi_score"), F.col("sample_size"), minimum).alias("status"),
    )


def hourly_volume(predictions: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return (
        predictions.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 hour").alias("w"), model_name(F.col("model_id")).alias("model_name"))
        .agg(F.count(F.lit(1)).alias("n_predictions"))
        .select("model_name", F.col("w.start").alias("hour"), "n_predictions")
    )


# --- alerts -----------------------------------------------------------------------------

_DEDUP_COLUMNS = "model_id string, id {id}, triggered_at timestamp, opens boolean, opened_at timestamp"


class AnchorDedup(StatefulProcessor):
    """Remembers per model when the open incident began; later alerts within the window join it.

    The window is anchored at the alert that opened the incident and is not extended
    by those that join. Only the times of a batch are held to put them in order.
    """

    def __init__(self, minutes: int = C.DEDUP_MINUTES) -> None:
        self.width = np.int64(minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(pdf["id"].to_numpy(), pdf["at"].to_numpy()) for pdf in rows]
        ids, times = (np.concatenate(column) for column in zip(*parts))
        # Text ids are ranked first: only numbers can be sorted by two keys.
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], times))
        ids, times = ids[order], times[order]
        stored = self.anchor.get()
        anchors, opened = ([stored[0]] if stored else []), []
        position = int(np.searchsorted(times, anchors[-1] + self.width, side="right")) if anchors else 0
        while position < len(times):
            opened.append(position)
            anchors.append(int(times[position]))
            position = int(np.searchsorted(times, anchors[-1] + self.width, side="right"))
        if opened:
            self.anchor.update((anchors[-1],))
        opens = np.zeros(len(times), dtype=bool)
        opens[opened] = True
        known = np.asarray(anchors, dtype=np.int64)
        # An alert older than every anchor arrived late and joins the first one.
        joined = known[np.maximum(np.searchsorted(known, times, side="right") - 1, 0)]
        yield pd.DataFrame(
            {
                "model_id": key[0], "id": ids, "triggered_at": pd.to_datetime(times, unit="us", utc=True),
                "opens": opens, "opened_at": pd.to_datetime(joined, unit="us", utc=True),
            }
        )

    def close(self) -> None:
        pass


def deduplicate_alerts(alerts: DataFrame, minutes: int = C.DEDUP_MINUTES) -> DataFrame:
    """Which alerts open an incident and which join one. Needs the RocksDB state store."""
    rows = alerts.select("model_id", "id", F.unix_micros("triggered_at").alias("at"))
    return rows.groupBy("model_id").transformWithStateInPandas(
        statefulProcessor=AnchorDedup(minutes), outputStructType=_DEDUP_COLUMNS.format(id=dict(alerts.dtypes)["id"]), outputMode="Append", timeMode="None"
    )


_NEWEST = "model_id string, id {id}, created_at timestamp"


def continuous_incidents(
    alerts: DataFrame,
    read_context: Callable[[SparkSession], dict[str, DataFrame]],
    folder: str,
    keep_hours: float = 24.0,
    minutes: int = C.DEDUP_MINUTES,
) -> DataStreamWriter:
    """Runs the incident pass on every batch of new alerts; offsets replace the processed flag.

    ``read_context`` returns deployments, upstream, drift and accuracy tables, of which only the
    time range of the batch is read. What a batch must know of earlier ones is each
    model's newest incident: one small table per batch, made from the one before it. An
    incident leaves it ``keep_hours`` after no alert can join it any more by time; an alert
    that is later than that opens a new one. Each batch writes its own folders, so a repeated
    batch replaces what it wrote before, and the files that it reads don't grow with history.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = _NEWEST.format(id=dict(batch.dtypes)["id"])
        before = spark.createDataFrame([], schema)
        if batch_id > 0:
            before = spark.read.schema(schema).parquet(f"{folder}/newest/batch={batch_id - 1}")
        opened, assigned = incidents.incident_pass(
            batch.withColumn("processed", F.lit(False)), before, **read_context(spark)
        )
        opened.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(
            f"{folder}/incidents/batch={batch_id}"
        )
        assigned.write.mode("overwrite").parquet(f"{folder}/assigned/batch={batch_id}")
        new = spark.read.schema(schema).parquet(f"{folder}/incidents/batch={batch_id}")
        oldest = batch.agg(F.min(F.unix_micros("triggered_at"))).first()[0]
        known = before.unionByName(new).groupBy("model_id").agg(F.max(F.struct("created_at", "id")).alias("n"))
        known = known.select("model_id", "n.id", "n.created_at")
        # One row per model.
        if oldest is not None:
            known = known.where(F.unix_micros("created_at") >= oldest - int(keep_hours * 3600e6) - minutes * 60_000_000)
        known.coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/newest/batch={batch_id}"
        )

    return alerts.writeStream.foreachBatch(handle)


# --- running ----------------------------------------------------------------------------


def run_available(
    writer: DataStreamWriter, checkpoint: str
) -> StreamingQuery:
    """Processes everything there is, in as many batches as the source makes, and stops."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dropped_late_rows(query: StreamingQuery) -> int:
    """How many rows came too late for their window, over all batches of a query."""
    return sum(
        operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators
    )
