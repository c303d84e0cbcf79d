"""One fit for the models of all tenants.

Rows of every tenant are prepared to one form: the tenant's name, a 0/1 label and an array
of numbers. Newton's method then takes a step for all models at once: tasks add up
gradients and second derivatives of the tenants they meet, Spark adds those up per tenant,
and each tenant's step is solved on its own. The rows are read once per step, of which
there are about eight, however many tenants there are; a tenant with most of all rows is
added up in parts like any other sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.config import Tenant
from driftlane.operators.modeling import LABEL, category_codes, numeric_statistics
from driftlane.session import materialise

_SUMS = "model_name string, sums array<double>"
_FITTED = "model_name string, coefficients array<double>, step double"


def prepared_rows(df: DataFrame, tenant: Tenant, fitted_on: DataFrame | None = None) -> DataFrame:
    """``id, model_name, label, features`` of a tenant's rows: filled and scaled numbers, then the codes of categories.

    Statistics and codes come from ``fitted_on`` (``df`` itself by default). Codes are
    joined: a stored table of a feature's categories is broadcast or shuffled by its
    size, so that millions of categories never lie on the driver. Unknown ones are -1.
    """
    source = df if fitted_on is None else fitted_on
    numbers = {r.feature: r for r in numeric_statistics(source, tenant.numeric).collect()}
    codes = materialise(category_codes(source, tenant.categorical))
    rows = df
    for i, name in enumerate(tenant.categorical):
        known = codes.where(F.col("feature") == name).select(F.col("category").alias(f"_t{i}"), F.col("code").alias(f"_c{i}"))
        rows = rows.withColumn(f"_t{i}", F.coalesce(F.col(name).cast("string"), F.lit("missing"))).join(known, f"_t{i}", "left")

    def scaled(name: str) -> Column:
        s = numbers[name]
        return (F.coalesce(F.col(name).try_cast("double"), F.lit(s["median"])) - s["mean"]) / (s["std"] or 1.0)

    features = [scaled(c) for c in tenant.numeric] + [F.coalesce(f"_c{i}", F.lit(-1)).cast("double") for i in range(len(tenant.categorical))]
    return rows.select(
        F.col(tenant.id_column).cast("string").alias("id"), F.lit(tenant.name).alias("model_name"),
        F.col(LABEL).cast("int").alias("label"), F.array(*features).alias("features"),
    )


def _weighted(prepared: DataFrame) -> DataFrame:
    """Rows with the weight that balances the classes of their model, and a one for the intercept."""
    counts = materialise(prepared.groupBy("model_name", "label").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("model_name").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    weights = counts.join(totals, "model_name").select("model_name", "label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))
    return prepared.join(materialise(weights), ["model_name", "label"]).select(
        "model_name", F.col("label").cast("double").alias("y"), "weight", F.concat("features", F.array(F.lit(1.0))).alias("x")
    )


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gradient and second derivatives of the rows of a task, one row per model that it meets."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, rows in batch.groupby("model_name", sort=False):
            x = np.stack(rows["x"].to_numpy())
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ rows["coefficients"].iloc[0], -700, 700)))
            w = rows["weight"].to_numpy()
            slope = x.T @ (w * (p - rows["y"].to_numpy()))
            curve = (x.T * (w * p * (1.0 - p))) @ x
            sums = np.concatenate([slope, curve.ravel()])
            found[name] = found[name] + sums if name in found else sums
    if found:
        yield pd.DataFrame({"model_name": list(found), "sums": list(found.values())})


def _newton_step(sums: pd.DataFrame) -> pd.DataFrame:
    """The next coefficients of one model; all but the intercept are drawn to zero."""
    sums = sums.sort_values("place")
    values, old = sums["value"].to_numpy(), np.asarray(sums["coefficients"].iloc[0])
    size = len(old)
    penalty = np.append(np.ones(size - 1), 0.0)
    slope, curve = values[:size] + penalty * old, values[size:].reshape(size, size) + np.diag(penalty)
    step = np.linalg.lstsq(curve, slope, rcond=None)[0]
    return pd.DataFrame({"model_name": [sums["model_name"].iloc[0]], "coefficients": [old - step], "step": [float(np.abs(step).max())]})


def _sums(weighted: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``model_name, place, value``: the gradient, then the second derivatives, summed over all rows of a model."""
    joined = weighted.join(coefficients.select("model_name", "coefficients"), "model_name")
    parts = joined.mapInPandas(_partial_sums, _SUMS)
    return parts.select("model_name", F.posexplode("sums").alias("place", "value")).groupBy("model_name", "place").agg(
        F.sum("value").alias("value")
    )


def fit_tenants(prepared: DataFrame, tolerance: float = 1e-8, steps: int = 50) -> DataFrame:
    """``model_name, coefficients`` (the intercept last) of every model in the prepared rows.

    Balanced logistic regression with half the squared coefficients as penalty, as
    ``modeling.fit`` has it. Models are done when no coefficient of any moves by more than
    ``tolerance``. Rows without a label are left out; a model with one class only gets
    an intercept that grows until ``steps`` are over.
    """
    weighted = materialise(_weighted(prepared.where(F.col("label").isNotNull())))
    fitted = materialise(weighted.groupBy("model_name").agg(
        F.transform(F.max_by("x", F.size("x")), lambda _: F.lit(0.0)).alias("coefficients")
    ))
    for _ in range(steps):
        sums = _sums(weighted, fitted).join(fitted.select("model_name", "coefficients"), "model_name")
        fitted = materialise(sums.groupBy("model_name").applyInPandas(_newton_step, _FITTED))
        if (fitted.agg(F.max("step")).first()[0] or 0.0) <= tolerance:
            break
    return fitted.select("model_name", "coefficients")


def gradients(prepared: DataFrame, fitted: DataFrame) -> DataFrame:
    """``model_name, place, gradient``: the slope of each model's objective per row; zero at its optimum and nowhere else."""
    weighted = _weighted(prepared.where(F.col("label").isNotNull()))
    size = F.size("coefficients")
    n = prepared.where(F.col("label").isNotNull()).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))
    sums = _sums(weighted, fitted).join(fitted, "model_name").join(n, "model_name").where(F.col("place") < size)
    pull = F.when(F.col("place") < size - 1, F.get("coefficients", F.col("place"))).otherwise(0.0)
    return sums.select("model_name", "place", ((F.col("value") + pull) / F.col("n")).alias("gradient"))


def score_tenants(prepared: DataFrame, fitted: DataFrame) -> DataFrame:
    """Prepared rows of all models with ``prediction``, ``confidence`` (of the predicted class) and ``probability_1``."""
    joined = prepared.join(fitted, "model_name")
    with_one = F.concat("features", F.array(F.lit(1.0)))
    margin = F.aggregate(F.zip_with(with_one, "coefficients", lambda x, c: x * c), F.lit(0.0), lambda total, v: total + v)
    probability = 1.0 / (1.0 + F.exp(-margin))
    return joined.withColumn("probability_1", probability).select(
        *[c for c in prepared.columns if c != "features"], (F.col("probability_1") > 0.5).alias("prediction"),
        F.greatest("probability_1", 1.0 - F.col("probability_1")).alias("confidence"), "probability_1",
    )
