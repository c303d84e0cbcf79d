"""Accuracy of predictions whose labels have arrived, and the labels themselves."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.functions.ids import model_name
from driftlane.functions.metrics import COUNTS, classification_metrics, metrics_of_counts, score_counts
from driftlane.functions.ranks import exact_quantiles
from driftlane.session import materialise

_METRICS = ("precision", "recall", "f1", "roc_auc")


def since(as_of: datetime, hours: float):
    return F.lit(as_of) - F.make_dt_interval(secs=F.lit(round(hours * 3600, 6)))


def labelled(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with their true label; unlabelled ones and orphan labels drop out."""
    return predictions.join(outcomes, predictions["id"] == outcomes["prediction_id"], "inner")


def accuracy_report(
    predictions: DataFrame,
    outcomes: DataFrame,
    as_of: datetime,
    hours: float = C.LOOKBACK_HOURS,
    minimum: int = C.MIN_ACCURACY_SAMPLES,
) -> DataFrame:
    """Metrics of the trailing window for every model with enough labelled rows.

    ``f1_exact`` keeps the unrounded value that the drop alert compares.
    """
    start = since(as_of, hours)
    recent = predictions.filter(F.col("created_at") >= start).select("id", "model_id", "prediction", "confidence")
    metrics = classification_metrics(
        labelled(recent, outcomes.select("prediction_id", "true_label")), ["model_id"]
    )
    return metrics.filter(F.col("n_samples") >= minimum).select(
        "model_id",
        start.alias("window_start"),
        F.lit(as_of).alias("window_end"),
        *[F.round(m, 4).alias(m) for m in _METRICS],
        "n_samples",
        F.lit(as_of).alias("created_at"),
        F.col("f1").alias("f1_exact"),
    )


def sliding_accuracy(
    predictions: DataFrame,
    outcomes: DataFrame,
    window: str = "24 hours",
    slide: str = "6 hours",
    minimum: int = C.MIN_ACCURACY_SAMPLES,
) -> DataFrame:
    """The same report for every window of a sliding schedule, in one job.

    If windows are whole numbers of slides, rows are counted per slide and score first,
    and the counts, not the rows, are repeated for the windows that a slide is in.
    """
    joined = labelled(
        predictions.select("id", "model_id", "prediction", "confidence", "created_at"),
        outcomes.select("prediction_id", "true_label"),
    )
    whole = pd.Timedelta(window) % pd.Timedelta(slide) == pd.Timedelta(0)
    pane = F.window("created_at", slide)["start"] if whole else F.col("created_at")
    counts = score_counts(joined.withColumn("pane", pane), ["model_id", "pane"])
    windowed = counts.withColumn("_w", F.window("pane", window, slide)).withColumn(
        "window_start", F.col("_w")["start"]
    ).withColumn("window_end", F.col("_w")["end"])
    keys = ["model_id", "window_start", "window_end"]
    metrics = metrics_of_counts(windowed.groupBy(*keys, "_s").agg(*[F.sum(c).alias(c) for c in COUNTS]), keys)
    return metrics.filter(F.col("n_samples") >= minimum).select(
        "model_id", "window_start", "window_end", "n_samples", *[F.round(m, 4).alias(m) for m in _METRICS]
    )


def accuracy_alerts(report: DataFrame, baseline: DataFrame, drop: float = C.F1_DROP) -> DataFrame:
    """A critical alert where F1 fell by ``drop`` or more; no baseline, no alert."""
    base = baseline.select("model_id", F.col("f1").alias("baseline_f1"))
    fall = F.col("baseline_f1") - F.col("f1_exact")
    fallen = report.join(base, "model_id", "left").filter(
        (F.coalesce("baseline_f1", F.lit(0.0)) > 0) & (fall >= drop)
    )
    parts = [
        F.round("f1_exact", 4).alias("current_f1"),
        F.round("baseline_f1", 4).alias("baseline_f1"),
        F.round(fall, 4).alias("drop"),
        F.col("n_samples"),
        F.lit(drop).alias("threshold"),
    ]
    return fallen.select(
        "model_id",
        F.lit("accuracy_drop").alias("alert_type"),
        F.lit("critical").alias("severity"),
        F.col("created_at").alias("triggered_at"),
        F.lit(False).alias("processed"),
        *parts,
        F.to_json(F.struct(*parts)).alias("details"),
    )


def label_coverage(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per model: predictions, how many have a label; orphan labels have no model.

    One shuffle on the id instead of two anti joins.
    """
    sides = predictions.select("id", "model_id", F.lit(1).alias("p"), F.lit(0).alias("o")).unionByName(
        outcomes.select(
            F.col("prediction_id").alias("id"), F.lit(None).cast("string").alias("model_id"),
            F.lit(0).alias("p"), F.lit(1).alias("o"),
        )
    )
    per_id = sides.groupBy("id").agg(
        F.max("model_id").alias("model_id"), F.sum("p").alias("p"), F.sum("o").alias("o")
    )
    return per_id.groupBy("model_id").agg(
        F.sum("p").alias("n_predictions"),
        F.sum(F.when(F.col("o") > 0, F.col("p")).otherwise(0)).alias("n_labelled"),
        F.sum(F.when(F.col("o") == 0, F.col("p")).otherwise(0)).alias("n_unlabelled"),
        F.sum(F.when(F.col("p") == 0, F.col("o")).otherwise(0)).alias("n_orphan_labels"),
    )


def label_latency(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Intended delay and observed label latency in seconds per model."""
    # Three passes follow; the join should run once.
    joined = materialise(
        labelled(
            predictions.select("id", "model_id", "created_at"),
            outcomes.select("prediction_id", "observed_at", "delay_seconds"),
        ).select(
            "model_id", "delay_seconds",
            ((F.unix_micros("observed_at") - F.unix_micros("created_at")) / 1e6).alias("latency"),
        )
    )
    quantiles = exact_quantiles(joined, ["model_id"], "latency", (0.5, 0.95))
    return (
        joined.groupBy("model_id")
        .agg(
            F.count(F.lit(1)).alias("n_labels"),
            F.round(F.avg("delay_seconds"), 4).alias("mean_intended"),
            F.round(F.avg("latency"), 4).alias("mean_observed"),
        )
        .join(quantiles, "model_id")
        .select(
            "model_id", "n_labels", "mean_intended", "mean_observed",
            F.round(F.col("quantiles")[0], 4).alias("p50_observed"),
            F.round(F.col("quantiles")[1], 4).alias("p95_observed"),
        )
    )


def labelled_training_rows(predictions: DataFrame, outcomes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Training extract: payload fields flattened next to the 0/1 label, per model."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    joined = labelled(
        predictions.select("id", "model_id", "input_features", "created_at"),
        outcomes.select("prediction_id", "true_label"),
    )
    parsed = joined.withColumn("_p", F.from_json("input_features", schema))
    return parsed.select(
        "id", "model_id", model_name(F.col("model_id")).alias("model_name"), "created_at",
        *[F.col("_p")[name].alias(name) for name in fields],
        F.col("true_label").cast("int").alias("label"),
    )
