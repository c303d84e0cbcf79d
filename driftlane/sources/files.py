"""Reading and writing the telemetry and baseline tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.functions.ids import model_name, model_version
from driftlane.operators.quality import number_or_zero

# Fixed schemas of the telemetry tables.
TABLES = {
    "predictions": (
        "id string, model_id string, input_features string, prediction boolean, confidence double, created_at timestamp"
    ),
    "outcomes": (
        "id string, prediction_id string, true_label boolean, delay_seconds double, observed_at timestamp"
    ),
    "upstream_events": (
        "id string, event_type string, started_at timestamp, ended_at timestamp, parameters string"
    ),
    "drift_reports": (
        "id string, model_id string, feature_name string, checked_at timestamp, psi_score double, method string, "
        "sample_size bigint, status string"
    ),
    "accuracy_reports": (
        "id string, model_id string, window_start timestamp, window_end timestamp, precision double, recall double, "
        "f1 double, roc_auc double, n_samples bigint, created_at timestamp"
    ),
    "alerts": (
        "id string, model_id string, alert_type string, severity string, triggered_at timestamp, processed boolean, "
        "details string"
    ),
    "deployments": (
        "id string, model_id string, version string, deployed_at timestamp, git_commit string, "
        "eval_metrics map<string,double>, is_current boolean, status string, training_data_summary string, "
        "traffic_percentage double, rejection_reason string, promoted_at timestamp"
    ),
    "incidents": (
        "id string, alert_id string, model_id string, hypothesis string, confidence double, evidence string, "
        "recommended_action string, status string, created_at timestamp, resolved_at timestamp, "
        "llm_explanation string, llm_confidence double, llm_suggested_action string"
    ),
    "llm_usage": (
        "id string, incident_id string, model_name string, tokens_in bigint, tokens_out bigint, "
        "cost_estimate double, called_at timestamp"
    ),
    "canary_deployments": (
        "id string, model_name string, candidate_version string, baseline_version string, traffic_percentage double, "
        "predictions_count bigint, min_observation_predictions bigint, status string, started_at timestamp, "
        "ended_at timestamp"
    ),
}
_EVENT_TIME = {
    "predictions": "created_at", "outcomes": "observed_at", "drift_reports": "checked_at",
    "accuracy_reports": "created_at", "alerts": "triggered_at", "deployments": "deployed_at",
    "incidents": "created_at", "llm_usage": "called_at", "upstream_events": "started_at",
    "canary_deployments": "started_at",
}

# Fixed schemas of the baseline tables; each also has the ``model_id``.
BASELINES = {
    "numeric": (
        "feature string, mean double, std double, median double, p25 double, p75 double, deciles array<double>, n_missing bigint"
    ),
    "categorical": "feature string, category string, cnt bigint",
    "prediction": "mean_confidence double, positive_class_ratio double, deciles array<double>",
    "metrics": "n_samples bigint, precision double, recall double, f1 double, roc_auc double",
}

SNAPSHOT = (
    "numeric map<string, struct<mean double, std double, median double, p25 double, p75 double, "
    "deciles array<double>, n_missing bigint>>, "
    "categorical map<string, struct<value_counts map<string,bigint>, n_missing bigint, n_unique bigint>>, "
    "prediction struct<mean_confidence double, deciles array<double>, positive_class_ratio double>"
)
_METRICS = "precision double, recall double, f1 double, roc_auc double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a stated schema; a missing path fails at once."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A raw CSV with a header, every column as text; a missing path fails at once."""
    return spark.read.option("header", True).csv(path)


def write_holdout(holdout: DataFrame, path: str) -> None:
    holdout.write.mode("overwrite").option("header", True).csv(path)


def read_holdout(spark: SparkSession, path: str, schema: str, numeric: Sequence[str]) -> DataFrame:
    """The held-out slice; blank numbers are customers without a charge yet, so zero."""
    rows = read_csv(spark, path, schema)
    return rows.select(*[number_or_zero(F.col(c)).alias(c) if c in numeric else F.col(c) for c in rows.columns])


def append_table(rows: DataFrame, root: str, table: str) -> None:
    """Append rows of a telemetry table, in folders per tenant (if any) and day.

    Rebalancing gathers the rows of a folder into few files and splits a large
    tenant or a busy day over several writers.
    """
    dated, folders = _foldered(rows, table)
    dated.hint("rebalance", *folders).write.mode("append").partitionBy(*folders).parquet(f"{root}/{table}")


def _foldered(rows: DataFrame, table: str) -> tuple[DataFrame, list[str]]:
    """Rows with their day and tenant (if any), and the folders these make."""
    dated = rows.withColumn("dt", F.to_date(_EVENT_TIME[table]))
    if "model_id" in rows.columns:
        return dated.withColumn("model_name", model_name(F.col("model_id"))), ["model_name", "dt"]
    return dated, ["model_name", "dt"] if "model_name" in rows.columns else ["dt"]


def commit_batch(rows: DataFrame, root: str, table: str, batch: str) -> None:
    """Append the rows of a batch, once however often it is tried.

    A batch has a folder of its own, which a repeated append replaces. The entry in the
    table of commits is written last: until then readers don't see the batch.
    """
    dated, folders = _foldered(rows, table)
    dated.hint("rebalance", *folders).write.mode("overwrite").partitionBy(*folders).parquet(f"{root}/{table}/batch={batch}")
    entry = rows.sparkSession.range(1).select(F.lit(batch).alias("batch"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}_commits/of={batch}")


def read_committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of all committed batches; filters on ``model_name`` and ``dt`` prune folders."""
    names = [part.rsplit(" ", 1)[0] for part in TABLES[table].split(", ")]
    tenant = "model_name string, " if "model_id" in names else ""
    rows = spark.read.schema(f"{TABLES[table]}, batch string, {tenant}dt date").parquet(f"{root}/{table}")
    commits = spark.read.schema("batch string").parquet(f"{root}/{table}_commits")
    return rows.join(commits, "batch", "left_semi").drop("batch")


def store_derived(rows: DataFrame, root: str, table: str) -> None:
    """Append rows that lack columns of the stored schema, or have numbers as ids.

    Numbers become text of equal length, so that ties by id are broken alike. An
    upstream event's feature goes into its parameters.
    """
    if table == "upstream_events" and "parameters" not in rows.columns:
        rows = rows.withColumn("parameters", F.to_json(F.struct("feature")))
    kinds = [part.rsplit(" ", 1) for part in TABLES[table].split(", ")]
    padded = rows.withColumn("id", F.lpad(F.col("id").cast("string"), 20, "0"))
    append_table(
        padded.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds]), root, table
    )


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A telemetry table; filters on ``model_name`` and ``dt`` prune folders."""
    extra = "dt date"
    if "model_id" in TABLES[table]:
        extra = "model_name string, dt date"
    return spark.read.schema(f"{TABLES[table]}, {extra}").parquet(f"{root}/{table}")


def read_stream(spark: SparkSession, root: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TABLES[table])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{root}/{table}")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Baseline documents as long tables: ``numeric``, ``categorical``, ``prediction``, ``metrics``.

    A document is ``{model_name, version, eval_metrics, training_data_snapshot}``; the
    snapshot of a retrained model may be stored as ``training_snapshot``. One
    without a snapshot contributes no rows.
    """
    schema = (
        f"model_name string, version string, eval_metrics struct<{_METRICS}>, "
        f"training_data_snapshot struct<{SNAPSHOT}>, training_snapshot struct<{SNAPSHOT}>"
    )
    docs = spark.read.schema(schema).option("multiLine", True).json(path).select(
        F.concat_ws(":", "model_name", "version").alias("model_id"), "eval_metrics",
        F.coalesce("training_data_snapshot", "training_snapshot").alias("s"),
    )
    numeric = docs.select("model_id", F.explode("s.numeric").alias("feature", "v")).select("model_id", "feature", "v.*")
    categorical = docs.select("model_id", F.explode("s.categorical").alias("feature", "v")).select(
        "model_id", "feature", F.explode("v.value_counts").alias("category", "cnt")
    )
    prediction = docs.filter("s.prediction IS NOT NULL").select("model_id", "s.prediction.*")
    metrics = docs.filter("eval_metrics IS NOT NULL").select("model_id", "eval_metrics.*")
    return {"numeric": numeric, "categorical": categorical, "prediction": prediction, "metrics": metrics}


def write_snapshot(numeric: DataFrame, categories: DataFrame, path: str) -> None:
    """Profiles as one baseline document per model, in the form that ``read_snapshot`` reads.

    A document holds what a model's features have, which is bounded by their number and
    by their categories.
    """
    numbers = numeric.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("mean", "std", "median", "p25", "p75", "deciles", "n_missing")
    ))).alias("numeric"))
    per_feature = categories.groupBy("model_id", "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "cnt"))).alias("value_counts"),
        F.sum("n_null").alias("n_missing"), F.count(F.lit(1)).alias("n_unique"),
    )
    texts = per_feature.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("value_counts", "n_missing", "n_unique")
    ))).alias("categorical"))
    documents = numbers.join(texts, "model_id", "full").select(
        F.col("model_id").alias("of"), model_name(F.col("model_id")).alias("model_name"), model_version(F.col("model_id")).alias("version"),
        F.struct("numeric", "categorical").alias("training_data_snapshot"),
    )
    # A file per model, in a folder of its own.
    documents.repartition("of").write.partitionBy("of").json(path)


def save_baseline(root: str, **tables: DataFrame) -> None:
    """Store baseline tables: numeric, categorical, prediction, metrics.

    A table has one folder per ``model_id``; saving a model again replaces its rows
    and leaves those of other models.
    """
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(
            f"{root}/baseline_{name}"
        )


def load_baseline(spark: SparkSession, root: str, name: str, model_id: str | None = None) -> DataFrame:
    """A baseline table, of all models or of one ``name:version``, which reads that folder only."""
    rows = spark.read.schema(f"model_id string, {BASELINES[name]}").parquet(f"{root}/baseline_{name}")
    return rows if model_id is None else rows.filter(F.col("model_id") == model_id)


def load_newest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A baseline table with the rows of each model's newest version, by its number."""
    rows = load_baseline(spark, root, name)
    number = F.regexp_extract("model_id", r":\D*(\d+)", 1).try_cast("int")
    # Folder names alone are read for this.
    newest = rows.select("model_id").distinct().groupBy(model_name(F.col("model_id")).alias("name")).agg(
        F.max(F.struct(number.alias("number"), "model_id"))["model_id"].alias("model_id")
    )
    return rows.join(newest.select("model_id"), "model_id", "left_semi")


def prediction_as_feature(prediction: DataFrame) -> DataFrame:
    """Stored score deciles in the shape of a numeric feature called ``_prediction``."""
    return prediction.select(
        "model_id", F.lit("_prediction").alias("feature"), F.col("mean_confidence").alias("mean"), "deciles"
    )
