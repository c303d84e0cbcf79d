"""Baseline profiles of training data: what drift is later measured against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.functions.ranks import exact_quantiles
from driftlane.operators.longform import usable_number

DECILES = tuple(i / 10 for i in range(1, 10))
_QUARTILES = (0.25, 0.5, 0.75)
KEYS = ["model_id", "feature"]


def numeric_profile(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Mean, sample deviation, quartiles, nine deciles and missing count per feature."""
    numbers = rows.filter("kind = 'numeric'")
    usable = usable_number(F.col("number"))
    value = F.when(usable, F.col("number"))
    moments = numbers.groupBy(*KEYS).agg(
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_samp(value), digits).alias("std"),
        F.count_if(~usable).alias("n_missing"),
    )
    quantiles = exact_quantiles(numbers, KEYS, "number", (*DECILES, *_QUARTILES))
    at = F.col("quantiles")
    return moments.join(quantiles, KEYS).select(
        *KEYS, "mean", "std",
        F.round(at[10], digits).alias("median"),
        F.round(at[9], digits).alias("p25"),
        F.round(at[11], digits).alias("p75"),
        F.transform(F.slice(at, 1, 9), lambda d: F.round(d, digits)).alias("deciles"),
        "n_missing",
    )


def category_counts(rows: DataFrame, missing: str = "nan") -> DataFrame:
    """Count per category; a missing value is a category of its own."""
    return (
        rows.filter("kind = 'categorical'")
        .groupBy(*KEYS, F.coalesce("category", F.lit(missing)).alias("category"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("category").isNull()).alias("n_null"))
    )


def categorical_profile(rows: DataFrame) -> DataFrame:
    """Missing and distinct category counts per feature."""
    return category_counts(rows).groupBy(*KEYS).agg(
        F.sum("cnt").alias("n_rows"), F.sum("n_null").alias("n_missing"), F.count(F.lit(1)).alias("n_unique")
    )


def prediction_profile(scored: DataFrame, digits: int = 4) -> DataFrame:
    """Mean, deciles and positive share of the scores a model gave."""
    keyed = scored.select("model_id", "confidence", "prediction")
    deciles = exact_quantiles(keyed, ["model_id"], "confidence", DECILES)
    totals = keyed.groupBy("model_id").agg(
        F.round(F.avg("confidence"), digits).alias("mean_confidence"),
        F.round(F.avg(F.col("prediction").cast("int")), digits).alias("positive_class_ratio"),
    )
    return totals.join(deciles, "model_id").select(
        "model_id", "mean_confidence", "positive_class_ratio",
        F.transform("quantiles", lambda d: F.round(d, digits)).alias("deciles"),
    )


def null_rates(current: DataFrame, baseline: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Share of missing values now against the baseline share, flagged past a rise."""

    def shares(rows: DataFrame, prefix: str) -> DataFrame:
        absent = F.when(F.col("kind") == "numeric", ~usable_number(F.col("number"))).otherwise(
            F.col("category").isNull()
        )
        return rows.filter("kind <> 'rows'").groupBy(*KEYS).agg(F.avg(absent.cast("int")).alias(prefix))

    rise = F.col("current_rate") - F.coalesce("baseline_rate", F.lit(0.0))
    return (
        shares(current, "current_rate")
        .join(shares(baseline, "baseline_rate"), KEYS, "left")
        .select(
            *KEYS,
            F.round("current_rate", 6).alias("current_rate"),
            F.round("baseline_rate", 6).alias("baseline_rate"),
            (rise > threshold).alias("high_null_rate"),
        )
    )
