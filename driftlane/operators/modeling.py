"""Training, scoring and retraining of the monitored models with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.config import Tenant
from driftlane.functions.metrics import classification_metrics
from driftlane.functions.ranks import exact_quantiles
from driftlane.functions.positions import positions
from driftlane.operators import canary, profile, quality, splits
from driftlane.operators.longform import feature_rows
from driftlane.session import materialise
from driftlane.sources import files

LABEL = "label"


def numeric_statistics(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Median, and mean and population deviation after filling gaps with it; ``feature`` rows."""
    rows = feature_rows(df, {c: F.col(c) for c in columns}, {}, keep=()).filter("kind = 'numeric'")
    medians = exact_quantiles(rows, ["feature"], "number", (0.5,)).select(
        "feature", F.col("quantiles")[0].alias("median")
    )
    filled = rows.join(medians, "feature").select("feature", "median", F.coalesce("number", "median").alias("v"))
    return filled.groupBy("feature").agg(
        F.first("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )


def category_codes(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The code of every category: its place in sorted order, with "missing" for nulls.

    Places are counted over ranges of the sorted categories, so that millions of one
    feature are numbered by many tasks.
    """
    rows = feature_rows(df, {}, {c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in columns}, keep=())
    distinct = rows.filter("kind = 'categorical'").select("feature", "category").distinct()
    return positions(distinct, ["feature"], ["category"], "code").select("feature", "category", F.col("code").cast("int").alias("code"))


def preprocessing(df: DataFrame, tenant: Tenant) -> list[Transformer]:
    """Stages fitted on ``df``: median fill and scaling, sorted codes with -1 for unknown."""
    numbers = {r.feature: r for r in numeric_statistics(df, tenant.numeric).collect()}
    fills = ", ".join(
        f"(coalesce(TRY_CAST(`{c}` AS DOUBLE), {numbers[c].median!r}D) - {numbers[c].mean!r}D) / "
        f"{(numbers[c].std or 1.0)!r}D AS `_n_{c}`"
        for c in tenant.numeric
    )
    texts = ", ".join(f"coalesce(CAST(`{c}` AS STRING), 'missing') AS `_t_{c}`" for c in tenant.categorical)
    clean = SQLTransformer(statement=f"SELECT *, {fills}, {texts} FROM __THIS__")
    indexer = StringIndexer(
        inputCols=[f"_t_{c}" for c in tenant.categorical], outputCols=[f"_k_{c}" for c in tenant.categorical],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(clean.transform(df))
    codes = ", ".join(
        f"CASE WHEN `_k_{c}` = {len(labels)} THEN -1D ELSE `_k_{c}` END AS `_c_{c}`"
        for c, labels in zip(tenant.categorical, indexer.labelsArray)
    )
    unknown = SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__")
    assembler = VectorAssembler(
        inputCols=[f"_n_{c}" for c in tenant.numeric] + [f"_c_{c}" for c in tenant.categorical], outputCol="features"
    )
    return [clean, indexer, unknown, assembler]


def fit(train: DataFrame, tenant: Tenant, iterations: int = 1000) -> PipelineModel:
    """Balanced, L2-regularised logistic regression over the preprocessed features."""
    stages = preprocessing(train, tenant)
    counts = {r[LABEL]: r["n"] for r in train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = "CASE " + " ".join(
        f"WHEN {LABEL} = {label} THEN {total / (len(counts) * n)!r}D" for label, n in counts.items()
    ) + " ELSE 0D END"
    weigh = SQLTransformer(statement=f"SELECT *, {weight} AS _weight FROM __THIS__")
    prepared = PipelineModel(stages).transform(train)
    model = LogisticRegression(
        featuresCol="features", labelCol=LABEL, weightCol="_weight", maxIter=iterations,
        regParam=1.0 / total, elasticNetParam=0.0, standardization=False,
    ).fit(weigh.transform(prepared))
    return PipelineModel([*stages, model])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction``, ``confidence`` (of the predicted class) and ``probability_1``."""
    scored = model.transform(df)
    probability = vector_to_array("probability")
    kept = [F.col(c) for c in df.columns]
    return scored.select(
        *kept, (F.col("prediction") == 1).alias("prediction"),
        F.array_max(probability).alias("confidence"), F.get(probability, F.lit(1)).alias("probability_1"),
    )


def evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Hold-out metrics, rounded to four digits; the ranking uses the positive class."""
    scored = score(model, df).withColumn("_y", F.col(LABEL) == 1).withColumn("_all", F.lit(0))
    metrics = classification_metrics(scored, ["_all"], score="probability_1", label="_y")
    return metrics.select("n_samples", *[F.round(m, 4).alias(m) for m in ("precision", "recall", "f1", "roc_auc")])


@dataclass
class Trained:
    model: PipelineModel
    metrics: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    prediction: DataFrame


def _baseline(model: PipelineModel, train: DataFrame, tenant: Tenant, model_id: str) -> dict[str, DataFrame]:
    keyed = train.withColumn("model_id", F.lit(model_id))
    rows = feature_rows(
        keyed, {c: F.col(c) for c in tenant.numeric}, {c: F.col(c) for c in tenant.categorical}
    )
    scored = materialise(
        score(model, keyed).select("model_id", "prediction", F.col("probability_1").alias("confidence"))
    )
    return {
        "numeric": profile.numeric_profile(rows),
        "categorical": profile.category_counts(rows).drop("n_null"),
        "prediction": profile.prediction_profile(scored),
    }


def _stored(labelled_rows: DataFrame, tenant: Tenant) -> DataFrame:
    """The columns training needs, written once, because fitting reads them many times."""
    return materialise(labelled_rows.select(tenant.id_column, *tenant.features, LABEL))


def train_model(labelled_rows: DataFrame, tenant: Tenant, version: str = "v1", store: str | None = None) -> Trained:
    """Hold-out by id order, stratified test split, fit, evaluation and baseline tables.

    With ``store`` the metrics and baselines are saved there under this version, for the
    accuracy and drift checks to load.
    """
    rows = _stored(labelled_rows, tenant)
    eligible = splits.ordered_holdout(rows, tenant.id_column).filter(~F.col("held_out")).drop("held_out")
    parts = materialise(splits.stratified_split(eligible, LABEL, tenant.id_column))
    train, test = parts.filter(~F.col("is_test")), parts.filter("is_test")
    model = fit(train, tenant)
    model_id = f"{tenant.name}:{version}"
    metrics = evaluate(model, test).withColumn("model_id", F.lit(model_id))
    trained = Trained(model, metrics, **_baseline(model, train, tenant, model_id))
    if store:
        files.save_baseline(
            store, numeric=trained.numeric, categorical=trained.categorical, prediction=trained.prediction, metrics=trained.metrics
        )
    return trained


def train_from_csv(spark: SparkSession, path: str, tenant: Tenant, version: str = "v1", store: str | None = None) -> Trained:
    """From a raw file of a tenant to its model and baselines."""
    return train_model(quality.training_rows(files.read_csv_text(spark, path), tenant), tenant, version, store)


def gradient(model: PipelineModel, train: DataFrame) -> DataFrame:
    """``place, gradient``: per coefficient (the intercept last) the slope of the fitted objective, per row.

    The objective is the class-balanced loss plus half the squared coefficients. Its
    gradient vanishes at the optimum and nowhere else, so it shows that a fit has converged.
    """
    fitted = model.stages[-1]
    coefficients = [float(c) for c in fitted.coefficients]
    counts = {r[LABEL]: r["n"] for r in train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(0.0)
    for label, n in counts.items():
        weight = F.when(F.col(LABEL) == label, total / (len(counts) * n)).otherwise(weight)
    scored = model.transform(train).select(
        vector_to_array("features").alias("x"), (weight * (vector_to_array("probability")[1] - F.col(LABEL))).alias("r")
    )
    slopes = [F.sum(F.col("r") * F.col("x")[i]) + c for i, c in enumerate(coefficients)]
    sums = scored.agg(F.array(*slopes, F.sum("r")).alias("g"), F.count(F.lit(1)).alias("n"))
    return sums.select("n", F.posexplode("g").alias("place", "g")).select("place", (F.col("g") / F.col("n")).alias("gradient"))


def retrain(
    labelled_rows: DataFrame, tenant: Tenant, current: PipelineModel | None, version: str, as_of: datetime,
    minimum: int = C.MIN_RETRAIN_SAMPLES, margin: float = C.GATE_MARGIN,
) -> tuple[DataFrame, PipelineModel | None]:
    """Candidate against serving model on the same hold-out; returns a deployment row.

    With too few labelled rows nothing is trained and the row says ``skipped``.
    """
    rows = _stored(labelled_rows, tenant)
    count = rows.count()
    if count < minimum:
        reason = f"{count} labelled rows, {minimum} are needed."
        row = labelled_rows.sparkSession.range(1).select(
            F.lit(tenant.name).alias("model_name"), F.lit("skipped").alias("status"),
            F.lit(reason).alias("rejection_reason"), F.lit(count).cast("bigint").alias("n_samples"),
        )
        return row, None
    parts = materialise(splits.stratified_split(rows, LABEL, tenant.id_column))
    train, held_out = parts.filter(~F.col("is_test")), parts.filter("is_test")
    candidate = fit(train, tenant)
    new = evaluate(candidate, held_out).select(F.lit(tenant.name).alias("model_name"), F.lit(version).alias("version"), "f1")
    if current is None:
        old = new.select("model_name", F.lit(0.0).alias("f1"))
    else:
        old = evaluate(current, held_out).select(F.lit(tenant.name).alias("model_name"), "f1")
    decision = canary.metric_gate(new, old, as_of, margin)
    return decision.withColumn("n_samples", F.lit(count).cast("bigint")), candidate
