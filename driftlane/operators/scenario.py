"""What-if perturbations of feature rows, and how strongly the detectors react."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.functions import psi
from driftlane.functions.ids import hash_bucket
from driftlane.operators import drift
from driftlane.operators.longform import ROWS, usable_number


@dataclass(frozen=True)
class Perturbation:
    """One change to one feature: ``kind`` is shift, skew, corrupt or delay."""

    kind: str
    feature: str = ""
    amount: float = 0.0
    value: str = ""
    probability: float = C.DEFAULT_SKEW_PROBABILITY
    started_at: datetime | None = None
    ended_at: datetime | None = None
    text: bool = False  # the feature is stored as text


def shifted(column: Column, amount: float, text: bool = False) -> Column:
    """Adds to a number; nulls stay, and in a ``text`` column also what is no number."""
    number = column.try_cast("double") + amount
    return F.when(number.isNotNull(), number.cast("string") if text else number).otherwise(column)


def skewed(column: Column, value: str, row_id: Column, probability: float = C.DEFAULT_SKEW_PROBABILITY) -> Column:
    """Sets a repeatable share of the rows to one category."""
    return F.when(hash_bucket(row_id) < int(probability * 10_000), F.lit(value)).otherwise(column)


def _active(p: Perturbation, at: Column | None) -> Column:
    if at is None:
        return F.lit(True)
    active = F.lit(True)
    if p.started_at is not None:
        active = active & (at >= F.lit(p.started_at))
    if p.ended_at is not None:
        active = active & (at < F.lit(p.ended_at))
    return active


def perturbed(
    columns: Mapping[str, Column], steps: Sequence[Perturbation], row_id: Column, at: Column | None = None
) -> dict[str, Column]:
    """Applies the steps in order; each sees the result of the ones before it."""
    result = dict(columns)
    for step in steps:
        if step.feature not in result or step.kind == "delay":
            continue
        before = result[step.feature]
        if step.kind == "shift":
            after = shifted(before, step.amount, step.text)
        elif step.kind == "skew":
            after = skewed(before, step.value, row_id, step.probability)
        elif step.kind == "corrupt":
            after = F.lit(None)
        else:
            raise ValueError(f"unknown perturbation {step.kind!r}")
        result[step.feature] = F.when(_active(step, at), after).otherwise(before)
    return result


def label_delay(delay: Column, steps: Sequence[Perturbation], at: Column) -> Column:
    """The delay times the factor of the first active spike."""
    factor = None
    for step in steps:
        if step.kind == "delay":
            condition, value = _active(step, at), F.lit(step.amount or C.DEFAULT_DELAY_MULTIPLIER)
            factor = F.when(condition, value) if factor is None else factor.when(condition, value)
    return delay if factor is None else delay * factor.otherwise(1.0)


def response_curve(
    current: DataFrame,
    scenarios: Mapping[str, Sequence[Perturbation]],
    numeric: Sequence[str],
    categorical: Sequence[str],
    row_id: str,
    edges: DataFrame,
    expected: DataFrame,
    as_of: datetime,
) -> DataFrame:
    """PSI of every feature under every scenario, from one pass over the rows.

    A row isn't repeated per scenario. Every feature is binned in each of its versions,
    of which there are as many as scenarios that change it; rows are counted per
    combination of bins, and only those counts are handed out to the scenarios.
    """
    base = {c: F.col(c) for c in (*numeric, *categorical)}
    versions, at = {c: [base[c]] for c in base}, {}
    for name, steps in scenarios.items():
        changed = perturbed(base, steps, F.col(row_id))
        for c in {step.feature for step in steps if step.kind != "delay" and step.feature in base}:
            versions[c].append(changed[c])
            at[name, c] = len(versions[c]) - 1

    def entry(kind: str, feature: str) -> Column:
        found = versions.get(feature, [])
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(feature).alias("feature"),
            F.array(*[v.try_cast("double") for v in found if kind == "numeric"]).cast("array<double>").alias("numbers"),
            F.array(*[v.cast("string") for v in found if kind == "categorical"]).cast("array<string>").alias("categories"),
        )

    entries = [entry("rows", ROWS), *[entry("numeric", c) for c in numeric], *[entry("categorical", c) for c in categorical]]
    long = current.select("model_id", F.explode(F.array(*entries)).alias("_e")).select("model_id", "_e.*")
    most = psi.most_edges(edges)

    def binned(i: int) -> Column:
        number = F.get("numbers", F.lit(i))
        return F.when(F.col("edges").isNotNull() & usable_number(number), psi.bin_number(number, F.col("edges"), most))

    bins = F.array(*[binned(i) for i in range(max((len(versions[c]) for c in numeric), default=0))]).cast("array<int>")
    counted = long.join(edges, drift.KEYS, "left").groupBy(
        *drift.KEYS, "kind", "categories", F.when(F.col("kind") == "numeric", bins).alias("bins")
    ).agg(F.count(F.lit(1)).alias("n"))

    def version(name: str) -> Column:
        index = F.lit(0)
        for (scenario, c), i in at.items():
            if scenario == name:
                index = F.when(F.col("feature") == c, i).otherwise(index)
        return index

    spread = counted.select("*", F.explode(F.array(*[
        F.struct(F.lit(name).alias("scenario"), version(name).alias("version")) for name in scenarios
    ])).alias("s"))
    per_scenario = spread.select(
        F.concat_ws("|", "model_id", "s.scenario").alias("model_id"), "feature", "kind", "n",
        F.get("bins", F.col("s.version")).alias("bin"), F.get("categories", F.col("s.version")).alias("category"),
    ).where("kind = 'rows' OR (kind = 'numeric' AND bin IS NOT NULL) OR (kind = 'categorical' AND category IS NOT NULL)")
    actual = per_scenario.groupBy(*drift.KEYS, "bin", "category").agg(F.sum("n").alias("actual"), F.lit(0.0).alias("total"))
    names = F.explode(F.array(*[F.lit(name) for name in scenarios])).alias("scenario")
    tagged = expected.select("*", names).withColumn("model_id", F.concat_ws("|", "model_id", "scenario")).drop("scenario")
    report = drift.report_of_counts(actual, tagged, as_of)
    return report.select(
        F.split_part("model_id", F.lit("|"), F.lit(1)).alias("model_id"),
        F.split_part("model_id", F.lit("|"), F.lit(2)).alias("scenario"),
        "feature_name", "psi_score", "sample_size", "status",
    )


def welch_statistic(rows: DataFrame, keys: Sequence[str], value: str, is_current: str = "is_current") -> DataFrame:
    """Welch's t and its degrees of freedom between current and baseline rows."""
    now, then = F.col(is_current), ~F.col(is_current)

    def of(function, side: Column) -> Column:
        return function(F.when(side, F.col(value)))

    sums = rows.groupBy(*keys).agg(
        of(F.count, now).alias("_n1"), of(F.avg, now).alias("_m1"), of(F.var_samp, now).alias("_v1"),
        of(F.count, then).alias("_n0"), of(F.avg, then).alias("_m0"), of(F.var_samp, then).alias("_v0"),
    )
    a, b = F.col("_v1") / F.col("_n1"), F.col("_v0") / F.col("_n0")
    return sums.select(
        *keys,
        F.try_divide(F.col("_m1") - F.col("_m0"), F.sqrt(a + b)).alias("t_statistic"),
        F.try_divide((a + b) ** 2, a**2 / (F.col("_n1") - 1) + b**2 / (F.col("_n0") - 1)).alias("degrees"),
    )


def chi_square_statistic(rows: DataFrame, keys: Sequence[str], category: str, is_current: str = "is_current") -> DataFrame:
    """Goodness of fit of current categories to the baseline shares."""
    counts = rows.groupBy(*keys, category).agg(
        F.count_if(is_current).alias("_c"), F.count_if(~F.col(is_current)).alias("_b")
    ).filter("_b > 0")
    # sum (c - N b / M)^2 / (N b / M)  =  M / N * sum c^2 / b - N
    sums = counts.groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.sum("_b").alias("_m"),
        F.sum(F.col("_c") * F.col("_c") / F.col("_b")).alias("_s"), F.count(F.lit(1)).alias("_k"),
    )
    return sums.select(
        *keys, (F.col("_s") * F.col("_m") / F.col("_n") - F.col("_n")).alias("chi_square"), (F.col("_k") - 1).alias("degrees")
    )
