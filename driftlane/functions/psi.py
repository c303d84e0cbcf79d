"""Population Stability Index over bin counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane import config as C


def inner_edges(points: Column) -> Column:
    """Cut points of a quantile array: distinct, sorted, outer two dropped.

    The outermost two become minus and plus infinity, so only the inner ones cut;
    fewer than three distinct points leave a single bin.
    """
    distinct = F.array_sort(F.array_distinct(points))
    empty = F.array().cast("array<double>")
    return F.when(F.size(distinct) > 2, F.slice(distinct, F.lit(2), F.size(distinct) - 2)).otherwise(empty)


def sigma_edges(median: Column, std: Column, bins: int = C.NUM_QUANTILE_BINS) -> Column:
    """Inner cut points spread evenly over median plus or minus three deviations."""
    spread = F.when(std == 0, F.lit(1.0)).otherwise(std)
    return F.array(*[median - 3.0 * spread + (6.0 * i / bins) * spread for i in range(1, bins)])


#: Up to so many cut points are written out as comparisons, which stay in generated code.
_WRITTEN_OUT = 64


def most_edges(edges: DataFrame) -> int:
    """The largest number of cut points in a stored table of edges."""
    return edges.agg(F.max(F.size("edges"))).first()[0] or 0


def bin_number(value: Column, edges: Column, most: int) -> Column:
    """Left-closed bin of ``value``: how many of the cut points, ``most`` of them at most, are at or below it."""
    if most > _WRITTEN_OUT:
        return F.size(F.filter(edges, lambda edge: edge <= value))
    number = F.lit(0)
    for i in range(most):
        number = number + F.when(F.get(edges, F.lit(i)) <= value, 1).otherwise(0)
    return number


def classify(score: Column, sample_size: Column, minimum: int = C.MIN_DRIFT_SAMPLES) -> Column:
    return (
        F.when(sample_size < minimum, "insufficient_data")
        .when(score < C.PSI_STABLE, "stable")
        .when(score < C.PSI_MODERATE, "moderate")
        .otherwise("significant")
    )


def psi_by_group(
    bins: DataFrame,
    keys: Sequence[str],
    expected: str = "expected",
    actual: str = "actual",
    extra: Sequence[Column] = (),
    epsilon: float = C.PSI_ZERO_SHARE,
) -> DataFrame:
    """PSI of each group from one row per bin, in a single aggregation.

    Empty bins get the share ``epsilon`` and both sides are renormalised. Written
    out, every logarithm splits into sums over bins plus terms in the two group
    totals, so no window over the bins is needed: a feature with very many
    categories is summed in parts like any other aggregate.
    """
    c, b = F.col(actual).cast("double"), F.col(expected).cast("double")
    both, only_expected, only_actual = (c > 0) & (b > 0), (c == 0) & (b > 0), (c > 0) & (b == 0)

    def total(value: Column, where: Column) -> Column:
        return F.sum(F.when(where, value).otherwise(0.0))

    ln_ratio = F.log(c / b)
    sums = bins.groupBy(*keys).agg(
        F.sum(c).alias("_N"), F.sum(b).alias("_M"),
        F.count_if(c == 0).alias("_empty_c"), F.count_if(b == 0).alias("_empty_b"),
        total(c, both).alias("_c"), total(b, both).alias("_b"),
        total(c * ln_ratio, both).alias("_c_ln"), total(b * ln_ratio, both).alias("_b_ln"),
        F.count_if(only_expected).alias("_n_oe"), total(b, only_expected).alias("_b_oe"),
        total(F.log(b), only_expected).alias("_ln_oe"), total(b * F.log(b), only_expected).alias("_bln_oe"),
        F.count_if(only_actual).alias("_n_oa"), total(c, only_actual).alias("_c_oa"),
        total(F.log(c), only_actual).alias("_ln_oa"), total(c * F.log(c), only_actual).alias("_cln_oa"),
        *extra,
    )
    n, m, eps, ln_eps = F.col("_N"), F.col("_M"), F.lit(epsilon), F.log(F.lit(epsilon))
    ln_n, ln_m = F.log(n), F.log(m)
    actual_side = (
        (F.col("_c_ln") + F.col("_c") * (ln_m - ln_n)) / n
        + eps * (F.col("_n_oe") * (ln_eps + ln_m) - F.col("_ln_oe"))
        + (F.col("_cln_oa") - F.col("_c_oa") * (ln_n + ln_eps)) / n
    ) / (1.0 + eps * F.col("_empty_c"))
    expected_side = (
        (F.col("_b_ln") + F.col("_b") * (ln_m - ln_n)) / m
        + (F.col("_b_oe") * (ln_eps + ln_m) - F.col("_bln_oe")) / m
        + eps * (F.col("_ln_oa") - F.col("_n_oa") * (ln_n + ln_eps))
    ) / (1.0 + eps * F.col("_empty_b"))
    score = F.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.round(actual_side - expected_side, 6))
    )
    internal = [name for name in sums.columns if name.startswith("_")]
    return sums.withColumn("psi_score", score).drop(*internal)
