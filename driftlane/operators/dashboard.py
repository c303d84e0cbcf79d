"""Summaries and histories that the monitoring screens show, for all tenants at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.functions.ids import model_name


def named(df: DataFrame) -> DataFrame:
    return df.withColumn("model_name", model_name(F.col("model_id")))


def available_models(*tables: DataFrame, defaults: Sequence[str] = C.DEFAULT_MODEL_NAMES) -> DataFrame:
    """Distinct tenant names over several tables, plus the configured ones."""
    configured = F.array(*[F.lit(d) for d in defaults]).cast("array<string>")
    names = tables[0].sparkSession.range(1).select(F.explode(configured).alias("model_name"))
    for df in tables:
        # Distinct per table first: only names travel to the union.
        names = names.union(named(df).select("model_name").filter("model_name <> ''").distinct())
    return names.distinct()


def latest_deployment(deployments: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Newest row per tenant, as a hash aggregate; ties go to the larger id."""
    return deployments.groupBy(*keys).agg(
        F.max_by(F.struct("version", "status", "traffic_percentage", "model_id", "id"), F.struct("deployed_at", "id")).alias(
            "latest"
        )
    )


def kpi_cards(
    deployments: DataFrame,
    predictions: DataFrame,
    alerts: DataFrame,
    incidents: DataFrame,
    open_statuses: Sequence[str] = ("investigating", "escalated"),
) -> DataFrame:
    """One card per tenant: serving version and traffic, volume, alerts, open incidents.

    A zero traffic share shows as 100, as an absent one does.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return named(df).groupBy("model_name").agg(F.count(F.lit(1)).alias(name))

    latest = latest_deployment(named(deployments)).select("model_name", "latest.*")
    cards = (
        latest.join(counted(predictions, "total_predictions"), "model_name", "full_outer")
        .join(counted(alerts, "alerts"), "model_name", "full_outer")
        .join(counted(incidents.filter(F.col("status").isin(*open_statuses)), "open_incidents"), "model_name", "full_outer")
    )
    traffic = F.when(F.col("version").isNull(), 0.0).otherwise(
        F.coalesce(F.nullif("traffic_percentage", F.lit(0.0)), F.lit(100.0))
    )
    return cards.select(
        "model_name",
        F.coalesce("version", F.lit("N/A")).alias("active_version"),
        F.coalesce("status", F.lit("Unknown")).alias("status"),
        traffic.alias("traffic_percentage"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_predictions", "alerts", "open_incidents")],
    )


def for_tenant(df: DataFrame, name: str, prefix: bool = False) -> DataFrame:
    """Rows of one tenant; ``prefix`` also takes longer names that start alike."""
    if prefix:
        return df.filter(F.col("model_id").startswith(name))
    return df.filter(model_name(F.col("model_id")) == name)


def deployment_history(deployments: DataFrame) -> DataFrame:
    return deployments.select(
        "model_id", "version", "status", "traffic_percentage", "rejection_reason", "deployed_at", "promoted_at"
    ).orderBy(F.desc("deployed_at"))


def drift_history(reports: DataFrame) -> DataFrame:
    return reports.select("model_id", "feature_name", "psi_score", "status", "sample_size", "checked_at").orderBy(
        "checked_at"
    )


def accuracy_history(reports: DataFrame) -> DataFrame:
    return reports.select(
        "model_id", F.col("n_samples").alias("sample_size"), "precision", "recall", "f1", "roc_auc",
        F.col("created_at").alias("checked_at"),
    ).orderBy("checked_at")


def incident_history(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "id", "model_id", "hypothesis", "confidence", "status", F.col("recommended_action").alias("action_taken"),
        "llm_explanation", "created_at",
    ).orderBy(F.desc("created_at"))


def prediction_timeline(predictions: DataFrame) -> DataFrame:
    return predictions.select("created_at", "model_id").orderBy("created_at")


def hourly_volume(predictions: DataFrame) -> DataFrame:
    """Predictions per tenant and hour, with empty hours between first and last as zero."""
    counts = (
        named(predictions)
        .groupBy("model_name", F.date_trunc("hour", "created_at").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hours = counts.groupBy("model_name").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(
        "model_name", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour")
    )
    empty = hours.withColumn("n", F.lit(0).cast("bigint"))
    return counts.unionByName(empty).groupBy("model_name", "hour").agg(F.sum("n").alias("n_predictions"))


def first_features(reports: DataFrame, count: int = 5) -> DataFrame:
    """Reports of the first ``count`` feature names of each tenant, the default selection."""
    rows = named(reports)
    names = rows.select("model_name", "feature_name").distinct()
    ranked = Window.partitionBy("model_name").orderBy("feature_name")
    chosen = names.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= count).drop("_r")
    return rows.join(chosen, ["model_name", "feature_name"], "left_semi")


def forward_fill(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Carry the last known value of each column forward in time within a group.

    Rows are filled within an hour, and a table of one row per group and hour carries
    values over from earlier ones. A long series is thus spread over its hours, and
    only the table of hours is ever ordered as a whole.
    """
    keys, order = list(keys), [time, *tie]
    hourly = df.withColumn("_hour", F.date_trunc("hour", time))
    in_hour = (
        Window.partitionBy(*keys, "_hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last_of_hour = hourly.groupBy(*keys, "_hour").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_hour.select(
        *keys, "_hour", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_carried_{c}") for c in columns]
    )
    filled = hourly.select(
        *[F.last(c, ignorenulls=True).over(in_hour).alias(c) if c in columns else F.col(c) for c in hourly.columns]
    )
    return filled.join(carried, [*keys, "_hour"], "left").select(
        *[F.coalesce(c, f"_carried_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def psi_pivot(reports: DataFrame, features: Sequence[str]) -> DataFrame:
    """PSI per check time (rows) and feature (columns), last value per cell, filled forward."""
    wide = (
        named(reports)
        .groupBy("model_name", "checked_at")
        .pivot("feature_name", list(features))
        .agg(F.max_by("psi_score", "id"))
    )
    return forward_fill(wide, ["model_name"], "checked_at", list(features))


def metric_series(reports: DataFrame, metrics: Sequence[str] = ("f1", "precision", "roc_auc")) -> DataFrame:
    rows = named(reports).select("model_name", "id", F.col("created_at").alias("checked_at"), *metrics)
    return forward_fill(rows, ["model_name"], "checked_at", list(metrics), tie=["id"])


def token_spend(
    usage: DataFrame,
    price_in: float = C.TOKEN_PRICE_IN_PER_MILLION,
    price_out: float = C.TOKEN_PRICE_OUT_PER_MILLION,
) -> DataFrame:
    """Token counts and cost per model and day; each call is rounded to six digits first."""
    cost: Column = F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 6)
    return usage.groupBy("model_name", F.to_date("called_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum(cost), 6).alias("cost_estimate"),
    )
