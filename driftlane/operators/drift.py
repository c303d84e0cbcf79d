"""Drift of all features of all tenants in one pass over the current rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.functions import psi
from driftlane.functions.ranks import exact_quantiles
from driftlane.operators.longform import PREDICTION, ROWS, usable_number
from driftlane.session import materialise

KEYS = ["model_id", "feature"]
_BIN_KEYS = [*KEYS, "bin", "category"]
ALL_FEATURES = "_all_features"


# --- bin edges: one row per model and numeric feature ---------------------------


def edges_from_rows(baseline: DataFrame, bins: int = C.NUM_QUANTILE_BINS) -> DataFrame:
    """Quantile cut points of the raw baseline rows."""
    numbers = baseline.filter("kind = 'numeric'")
    steps = [i / bins for i in range(bins + 1)]
    quantiles = exact_quantiles(numbers, KEYS, "number", steps)
    return quantiles.select(*KEYS, psi.inner_edges(F.col("quantiles")).alias("edges"))


def edges_from_deciles(profile: DataFrame) -> DataFrame:
    """Cut points of stored deciles, the outer two taken as open ends."""
    return profile.select(*KEYS, psi.inner_edges(F.col("deciles")).alias("edges"))


def edges_between_deciles(profile: DataFrame) -> DataFrame:
    """Every distinct decile as a cut point; goes with ``decile_mass``."""
    return profile.select(*KEYS, F.array_sort(F.array_distinct("deciles")).alias("edges"))


def edges_from_sigma(profile: DataFrame) -> DataFrame:
    """Evenly spaced cut points, for profiles stored without deciles."""
    return profile.select(*KEYS, psi.sigma_edges(F.col("median"), F.col("std")).alias("edges"))


# --- expected mass: one row per bin or category ---------------------------------


def _each_bin(edges: DataFrame) -> DataFrame:
    return edges.select(
        *KEYS, "edges", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"),
        F.lit(None).cast("string").alias("category"),
    )


def uniform_mass(edges: DataFrame) -> DataFrame:
    return _each_bin(edges).select(*_BIN_KEYS, F.lit(1.0).alias("expected"))


def decile_mass(profile: DataFrame) -> DataFrame:
    """The true share of each bin when all nine deciles cut: tenths, added up over ties."""
    cuts = F.array_sort(F.array_distinct("deciles"))
    edges = profile.select(*KEYS, "deciles", cuts.alias("edges"))
    spread = edges.select(*KEYS, "deciles", "edges", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))

    def deciles_below(position):
        return F.when(position >= F.size("edges"), F.lit(10)).otherwise(
            F.size(F.filter("deciles", lambda d: d <= F.get(F.col("edges"), position)))
        )

    mass = deciles_below(F.col("bin")) - F.when(F.col("bin") == 0, 0).otherwise(deciles_below(F.col("bin") - 1))
    return spread.select(
        *KEYS, "bin", F.lit(None).cast("string").alias("category"), (mass / 10.0).alias("expected")
    )


def category_mass(counts: DataFrame) -> DataFrame:
    return counts.select(
        *KEYS, F.lit(None).cast("int").alias("bin"), "category", F.col("cnt").cast("double").alias("expected")
    )


# --- the report -------------------------------------------------------------------


def _binned(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with their bin; numeric features without a baseline and nulls drop out."""
    usable = (
        (F.col("kind") == "rows")
        | ((F.col("kind") == "numeric") & usable_number(F.col("number")) & F.col("edges").isNotNull())
        | ((F.col("kind") == "categorical") & F.col("category").isNotNull())
    )
    number = F.when(F.col("kind") == "numeric", psi.bin_number(F.col("number"), F.col("edges"), psi.most_edges(edges)))
    return rows.join(edges, KEYS, "left").filter(usable).withColumn("bin", number)


def _report(bins: DataFrame, as_of: datetime, minimum: int) -> DataFrame:
    """Scores and the small-sample guard from counted bins (expected, actual, total).

    The counted bins are tiny next to the rows and are read three times below, so
    they are written once instead of scanning the rows again.
    """
    bins = materialise(bins)
    scored = psi.psi_by_group(
        bins.filter(F.col("feature") != ROWS), KEYS,
        extra=[
            F.sum("total").alias("_total"),
            F.sum("actual").alias("current_count"),
            F.sum("expected").alias("expected_mass"),
            F.try_divide(F.sum("total"), F.sum("actual")).alias("current_mean"),
        ],
    )
    # Categories that no baseline names are not monitored features.
    scored = scored.filter("expected_mass > 0").drop("expected_mass")
    # Every model with a baseline is reported, also with no current rows at all.
    samples = bins.groupBy("model_id").agg(
        F.sum(F.when(F.col("feature") == ROWS, F.col("actual")).otherwise(0)).alias("sample_size"),
        F.sum("expected").alias("_mass"),
    ).filter("_mass > 0").drop("_mass")
    enough = scored.join(samples.filter(F.col("sample_size") >= minimum), "model_id").select(
        "model_id", F.col("feature").alias("feature_name"), "psi_score", "sample_size",
        psi.classify(F.col("psi_score"), F.col("sample_size"), minimum).alias("status"), "current_mean",
    )
    too_few = samples.filter(F.col("sample_size") < minimum).select(
        "model_id", F.lit(ALL_FEATURES).alias("feature_name"), F.lit(0.0).alias("psi_score"), "sample_size",
        F.lit("insufficient_data").alias("status"), F.lit(None).cast("double").alias("current_mean"),
    )
    return enough.unionByName(too_few).select(
        "*", F.lit("PSI").alias("method"), F.lit(as_of).alias("checked_at")
    )


def drift_report(
    current: DataFrame,
    edges: DataFrame,
    expected: DataFrame,
    as_of: datetime,
    minimum: int = C.MIN_DRIFT_SAMPLES,
) -> DataFrame:
    """One report row per model and feature against stored baseline tables.

    ``edges`` and ``expected`` come from stored profiles: files of known size, so
    Spark broadcasts them by size or not at all. The current rows are scanned once
    and reduced to bins before the only shuffle.
    """
    counted = _binned(current, edges).groupBy(*_BIN_KEYS).agg(
        F.count(F.lit(1)).alias("actual"), F.sum("number").alias("total")
    )
    return report_of_counts(counted, expected, as_of, minimum)


def report_of_counts(counted: DataFrame, expected: DataFrame, as_of: datetime, minimum: int = C.MIN_DRIFT_SAMPLES) -> DataFrame:
    """The report from current rows already counted per bin (``actual``, and ``total`` of their numbers)."""
    bins = (
        expected.select(*_BIN_KEYS, "expected", F.lit(0).cast("bigint").alias("actual"), F.lit(0.0).alias("total"))
        .unionByName(counted.withColumn("expected", F.lit(0.0)))
        .groupBy(*_BIN_KEYS)
        .agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"), F.sum("total").alias("total"))
    )
    return _report(bins, as_of, minimum)


def drift_report_from_rows(
    rows: DataFrame,
    as_of: datetime,
    minimum: int = C.MIN_DRIFT_SAMPLES,
    bins: int = C.NUM_QUANTILE_BINS,
) -> DataFrame:
    """Drift when the baseline is itself a set of rows.

    ``rows`` carries a boolean ``is_current``; both sides are binned in one scan.
    """
    edges = materialise(edges_from_rows(rows.filter("NOT is_current"), bins))
    counted = _binned(rows, edges).groupBy(*_BIN_KEYS).agg(
        F.count_if(~F.col("is_current")).cast("double").alias("expected"),
        F.count_if(F.col("is_current")).alias("actual"),
        F.sum(F.when(F.col("is_current"), F.col("number"))).alias("total"),
    )
    empty = _each_bin(edges).select(
        *_BIN_KEYS, F.lit(0.0).alias("expected"), F.lit(0).cast("bigint").alias("actual"), F.lit(0.0).alias("total")
    )
    complete = counted.unionByName(empty).groupBy(*_BIN_KEYS).agg(
        F.sum("expected").alias("expected"), F.sum("actual").alias("actual"), F.sum("total").alias("total")
    )
    return _report(complete, as_of, minimum)


def drift_alerts(report: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Warning and critical alerts with a JSON payload; insufficient data raises none."""
    drifting = report.filter(F.col("status").isin("moderate", "significant"))
    if profile is not None:
        means = profile.select("model_id", F.col("feature").alias("feature_name"), F.col("mean").alias("baseline_mean"))
        drifting = drifting.join(means, ["model_id", "feature_name"], "left")
    else:
        drifting = drifting.withColumn("baseline_mean", F.lit(None).cast("double"))
    details = F.to_json(
        F.struct(
            F.col("feature_name").alias("feature"), "psi_score", "status", "sample_size",
            "baseline_mean", F.when(F.col("baseline_mean").isNotNull(), F.col("current_mean")).alias("current_mean"),
        )
    )
    return drifting.select(
        "model_id",
        F.when(F.col("feature_name") == PREDICTION, "prediction_drift").otherwise("feature_drift").alias("alert_type"),
        F.when(F.col("status") == "significant", "critical").otherwise("warning").alias("severity"),
        F.col("checked_at").alias("triggered_at"),
        F.lit(False).alias("processed"),
        "feature_name", "psi_score", "baseline_mean",
        F.when(F.col("baseline_mean").isNotNull(), F.col("current_mean")).alias("current_mean"),
        details.alias("details"),
    )
