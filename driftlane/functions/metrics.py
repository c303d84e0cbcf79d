"""Classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cells per halving of the distance to 0 or to 1, coarse and fine.
_SCORE_CELLS = (1 << 4, 1 << 20)
COUNTS = ("pos", "neg", "tp", "fp")


def _stretched(score: Column) -> Column:
    """A rising function that spreads the scores next to 0 and to 1, where most of them may lie."""
    low, high = (F.log2(F.greatest(x, F.lit(1e-300))) for x in (score, 1.0 - score))
    return F.when(score < 0.5, low).otherwise(-high)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def classification_metrics(
    scored: DataFrame,
    keys: Sequence[str],
    prediction: str = "prediction",
    score: str = "confidence",
    label: str = "true_label",
) -> DataFrame:
    """Sample count, precision, recall, F1 and tie-exact ROC-AUC per group, unrounded.

    Rows are counted per distinct score, which serves the confusion counts and the
    ranking alike. The negatives below a score are a sum of three prefix sums: over
    coarse cells of the score range, over fine ones within one, and over scores
    within one of those; so no window ever holds a whole group. Cells get narrower
    towards 0 and 1. Scores lie in [0, 1]. A group with a single class has AUC 0.5.
    """
    return metrics_of_counts(score_counts(scored, keys, prediction, score, label), keys)


def score_counts(
    scored: DataFrame, keys: Sequence[str], prediction: str = "prediction", score: str = "confidence",
    label: str = "true_label",
) -> DataFrame:
    """``keys, _s, pos, neg, tp, fp``: one row per group and distinct score; such counts can be added up."""
    return (
        scored.select(*keys, F.col(prediction).alias("_p"), F.col(label).alias("_y"), F.col(score).alias("_s"))
        .groupBy(*keys, "_s")
        .agg(
            F.count_if("_y").alias("pos"),
            F.count_if(~F.col("_y")).alias("neg"),
            F.count_if(F.col("_p") & F.col("_y")).alias("tp"),
            F.count_if(F.col("_p") & ~F.col("_y")).alias("fp"),
        )
    )


def metrics_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The metrics of each group from its counts per distinct score."""
    keys = list(keys)
    coarse, fine = (F.floor(_stretched(F.col("_s")) * cells) for cells in _SCORE_CELLS)
    totals = COUNTS
    level = (
        counts
        .withColumn("_coarse", coarse)
        .withColumn("_fine", fine)
        .withColumn("_area", F.col("pos") * F.col("neg") / 2.0)
    )
    # Scores within a fine cell, fine cells within a coarse one, coarse cells.
    for partition, order in (
        ([*keys, "_coarse", "_fine"], "_s"),
        ([*keys, "_coarse"], "_fine"),
        (keys, "_coarse"),
    ):
        ordered = Window.partitionBy(*partition).orderBy(order)
        running = F.sum("neg").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        level = level.withColumn("_below", running - F.col("neg")).groupBy(*partition).agg(
            F.sum(F.col("_area") + F.col("pos") * F.col("_below")).alias("_area"),
            *[F.sum(name).alias(name) for name in totals],
        )
    pos, neg, tp, fp = (F.col(name) for name in totals)
    return level.select(
        *keys,
        (pos + neg).alias("n_samples"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, pos).alias("recall"),
        ratio(2 * tp, tp + fp + pos).alias("f1"),
        F.when((pos == 0) | (neg == 0), 0.5)
        .otherwise(F.try_divide(F.col("_area"), pos.cast("double") * neg))
        .alias("roc_auc"),
    )


def confusion(prediction: str = "prediction", label: str = "true_label") -> list[Column]:
    """The counts precision, recall and F1 are made of, as plain aggregates."""
    predicted, actual = F.col(prediction), F.col(label)
    return [
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
    ]


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )
