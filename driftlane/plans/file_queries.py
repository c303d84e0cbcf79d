"""Round trips of the given tables through the file sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftlane.operators import profile
from driftlane.operators.longform import feature_rows
from driftlane.plans.registry import query
from driftlane.session import shared_folder
from driftlane.sources import driver_tables as T
from driftlane.sources import files
from driftlane.streaming import streams


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(
    "holdout_csv_round_trip",
    """SELECT c_name AS "customerID", CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS "TotalCharges" FROM customer""",
)
def holdout_csv_round_trip(spark, sf_dir):
    """A held-out slice through CSV; customers in debt have a blank charge, which reads as zero."""
    charge = F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_acctbal").cast("string"))
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_name").alias("customerID"), charge.alias("TotalCharges"))
    path = f"{_folder(spark)}/holdout"
    files.write_holdout(rows, path)
    return files.read_holdout(spark, path, "customerID string, TotalCharges string", ["TotalCharges"])


def _stored_alerts(spark, sf_dir, root):
    """Alerts in the stored schema, appended in two parts."""
    rows = T.alerts(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), "model_id", "alert_type", "severity", "triggered_at", "processed",
        F.lit("{}").alias("details"),
    )
    for part in ("processed", "NOT processed"):
        files.append_table(rows.filter(part), root, "alerts")


@query(
    "stored_alerts",
    """
SELECT split_part(model_id, ':', 1) AS model_name, strftime(triggered_at, '%Y-%m-%d') AS day, count(*) AS n,
       count(*) FILTER (processed) AS n_processed
FROM alerts GROUP BY ALL""",
)
def stored_alerts(spark, sf_dir):
    root = _folder(spark)
    _stored_alerts(spark, sf_dir, root)
    return files.read_table(spark, root, "alerts").groupBy("model_name", F.col("dt").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("processed").alias("n_processed")
    )


@query(
    "stored_alert_stream",
    """SELECT CAST(id AS VARCHAR) AS id, model_id, alert_type, processed FROM alerts""",
)
def stored_alert_stream(spark, sf_dir):
    """The stored table read back as a stream, part by part."""
    root = _folder(spark)
    _stored_alerts(spark, sf_dir, root)
    stream = files.read_stream(spark, root, "alerts", files_per_batch=100).select("id", "model_id", "alert_type", "processed")
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out").outputMode("append")
    streams.run_available(writer, f"{root}/offsets")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(
    "stored_baseline",
    """
SELECT model_id, feature, round(avg(v), 4) AS mean FROM feat_numeric
WHERE model_id = 'm1:v1' OR NOT is_current GROUP BY ALL""",
)
def stored_baseline(spark, sf_dir):
    """Profiles of all models saved, then that of one over all its rows, which replaces the old one only."""
    root = _folder(spark)
    rows = T.feature_table(spark, sf_dir)

    def profiled(df):
        long = feature_rows(df, {c: F.col(c) for c in T.NUMERIC_FEATURES}, {})
        return profile.numeric_profile(long).select("model_id", "feature", F.round("mean", 4).alias("mean"))

    files.save_baseline(root, numeric=profiled(rows.filter(F.col("created_at") < F.lit(T.DRIFT_SPLIT))))
    files.save_baseline(root, numeric=profiled(rows.filter(F.col("model_id") == "m1:v1")))
    others = files.load_baseline(spark, root, "numeric").filter(F.col("model_id") != "m1:v1")
    return others.unionByName(files.load_baseline(spark, root, "numeric", "m1:v1")).select("model_id", "feature", "mean")


@query(
    "committed_alerts",
    """SELECT CAST(id AS VARCHAR) AS id, model_id, alert_type, strftime(triggered_at, '%Y-%m-%d') AS day FROM alerts WHERE NOT processed""",
)
def committed_alerts(spark, sf_dir):
    """A batch that is appended twice, one that is replaced, and one that was never committed."""
    root = _folder(spark)
    rows = T.alerts(spark, sf_dir).withColumn("id", F.col("id").cast("string")).withColumn("details", F.lit("{}"))
    critical, warning = (rows.filter(F.col("severity") == s) for s in ("critical", "warning"))
    files.commit_batch(critical.filter("NOT processed"), root, "alerts", "1")
    files.commit_batch(critical.filter("NOT processed"), root, "alerts", "1")
    files.commit_batch(warning, root, "alerts", "2")
    files.commit_batch(warning.filter("NOT processed"), root, "alerts", "2")
    lost = rows.withColumn("model_name", F.lit("lost")).withColumn("dt", F.to_date("triggered_at"))
    lost.write.partitionBy("model_name", "dt").parquet(f"{root}/alerts/batch=3")
    return files.read_committed(spark, root, "alerts").select("id", "model_id", "alert_type", F.col("dt").cast("string").alias("day"))


_PROFILES = """
numbers AS (SELECT model_id, feature, round(avg(v), 4) AS mean, round(median(v), 4) AS median,
                   count(*) FILTER (v IS NULL) AS n_missing FROM feat_numeric WHERE NOT is_current GROUP BY ALL),
categories AS (SELECT model_id, feature, coalesce(v, 'nan') AS category, count(*) AS cnt FROM feat_category WHERE NOT is_current GROUP BY ALL)"""


@query(
    "baseline_documents",
    f"""WITH {_PROFILES}
SELECT model_id, feature, CAST(NULL AS VARCHAR) AS category, mean, median, n_missing, CAST(NULL AS BIGINT) AS cnt FROM numbers
UNION ALL SELECT model_id, feature, category, NULL, NULL, NULL, cnt FROM categories""",
)
def baseline_documents(spark, sf_dir):
    """Baselines written as one JSON document per model, as training stores them, and loaded back."""
    before = T.feature_table(spark, sf_dir).filter(F.col("created_at") < F.lit(T.DRIFT_SPLIT))
    long = feature_rows(before, {c: F.col(c) for c in T.NUMERIC_FEATURES}, {c: F.col(c) for c in T.CATEGORICAL_FEATURES})
    path = f"{_folder(spark)}/documents"
    files.write_snapshot(profile.numeric_profile(long), profile.category_counts(long), path)
    tables = files.read_snapshot(spark, path)
    numeric = tables["numeric"].select(
        "model_id", "feature", F.lit(None).cast("string").alias("category"), "mean", "median", "n_missing", F.lit(None).cast("bigint").alias("cnt")
    )
    return numeric.unionByName(tables["categorical"], allowMissingColumns=True)
