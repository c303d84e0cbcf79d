"""The given tables, and the telemetry tables derived from them.

Each telemetry table is a deterministic projection of a given one, so every query
over it grows with the data. Schemas are stated, which saves the inference job and
reads the zone-less timestamps as UTC instants that filters can be pushed to.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

DRIFT_SPLIT = datetime(1998, 1, 1, tzinfo=timezone.utc)
PREDICTION_SPLIT = datetime(2000, 1, 1, tzinfo=timezone.utc)
PREDICTIONS_AS_OF = datetime(2001, 8, 2, tzinfo=timezone.utc)
EVENTS_AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
MAX_PRICE = 500_000.0

NUMERIC_FEATURES = ("quantity", "extendedprice", "discount", "tax")
CATEGORICAL_FEATURES = ("returnflag", "linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _tenant(number: Column, count: int) -> Column:
    return F.concat(F.lit("m"), (number % count).cast("string"), F.lit(":v1"))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with four numeric and two categorical features, for four tenants."""
    return table(spark, sf_dir, "lineitem").select(
        _tenant(F.col("l_suppkey"), 4).alias("model_id"),
        F.col("l_orderkey").alias("row_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("paid_tax"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per order; the confidence is the price scaled to 0..1."""
    confidence = F.col("o_totalprice") / MAX_PRICE
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("m"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"), F.lit(":v1")).alias(
            "model_id"
        ),
        F.to_json(
            F.struct(
                F.col("o_totalprice").alias("price"),
                F.nullif(F.col("o_custkey") % 100, F.lit(0)).alias("segment"),
                F.col("o_orderstatus").alias("status"),
            )
        ).alias("input_features"),
        (confidence >= 0.5).alias("prediction"),
        confidence.alias("confidence"),
        F.col("o_orderdate").alias("created_at"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One late label per order that has lines; some orders never get one."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("prediction_id"))
        .agg(
            (F.count_if(F.col("l_returnflag") == "R") > 0).alias("true_label"),
            F.max("l_shipdate").alias("observed_at"),
        )
        .withColumn("delay_seconds", F.lit(300.0))
    )


def document_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions over documents: long texts are called good, by source as tenant."""
    length = F.col("n_chars").cast("double")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("lang"), F.lit(":v1")).alias("model_id"),
        (F.col("n_chars") >= 1000).alias("prediction"),
        (length / (length + 1000.0)).alias("confidence"),
    )


def document_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("prediction_id"), (F.col("quality") == 1).alias("true_label")
    )


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "error").select(
        F.col("event_id").alias("id"),
        _tenant(F.col("user_id"), 5).alias("model_id"),
        F.when(F.col("event_id") % 3 == 0, "accuracy_drop").otherwise("feature_drift").alias("alert_type"),
        F.when(F.col("value") > 50, "critical").otherwise("warning").alias("severity"),
        F.col("ts").alias("triggered_at"),
        (F.col("event_id") % 4 == 0).alias("processed"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("deployed", "canary", "rejected", "canary_failed")]),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    rows = _events(spark, sf_dir, "signup").filter(F.col("value") > 80).select(
        F.col("event_id").alias("id"),
        _tenant(F.col("user_id"), 5).alias("model_id"),
        F.concat(F.lit("v"), (F.col("event_id") % 9 + 1).cast("string")).alias("version"),
        F.col("ts").alias("deployed_at"),
        status.alias("status"),
        (F.col("event_id") % 5 * 25.0).alias("traffic_percentage"),
        F.when(status == "rejected", "below the gate").alias("rejection_reason"),
        F.when(status == "deployed", F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("promoted_at"),
        F.substring(F.md5(F.col("event_id").cast("string")), 1, 7).alias("git_commit"),
    )
    newest = rows.groupBy("model_id").agg(F.max(F.struct("deployed_at", "id"))["id"].alias("_newest"))
    return rows.join(newest, "model_id").withColumn("is_current", F.col("id") == F.col("_newest")).drop("_newest")


def upstream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    still_active = F.col("ts") >= F.lit(datetime(2024, 1, 30, tzinfo=timezone.utc))
    return _events(spark, sf_dir, "purchase").filter(F.col("value") > 150).select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "drift_numeric").otherwise("corrupt_feature").alias("event_type"),
        F.concat(F.lit("f"), (F.col("event_id") % 6).cast("string")).alias("feature"),
        F.col("ts").alias("started_at"),
        F.when(~still_active, F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ended_at"),
    )


def drift_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.get_json_object("props", "$.k").cast("bigint") % 6
    score = F.col("value") / 2000.0
    return _events(spark, sf_dir, "view").select(
        F.col("event_id").alias("id"),
        _tenant(F.col("user_id"), 5).alias("model_id"),
        F.when(slot == 5, "_prediction").otherwise(F.concat(F.lit("f"), slot.cast("string"))).alias("feature_name"),
        F.col("ts").alias("checked_at"),
        score.alias("psi_score"),
        F.lit(1000).cast("bigint").alias("sample_size"),
        F.when(score < 0.10, "stable").when(score < 0.25, "moderate").otherwise("significant").alias("status"),
    )


def accuracy_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "click").filter(F.col("value") > 150).select(
        F.col("event_id").alias("id"),
        _tenant(F.col("user_id"), 5).alias("model_id"),
        (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("window_start"),
        F.col("ts").alias("window_end"),
        F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") / 500.0, 4)).alias("f1"),
        F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") / 700.0, 4)).alias("precision"),
        F.round(F.col("value") / 900.0, 4).alias("recall"),
        F.round(F.col("value") / 1100.0, 4).alias("roc_auc"),
        (F.col("event_id") % 1000).alias("n_samples"),
        F.col("ts").alias("created_at"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of an earlier pass, from every 50th alert or so."""
    status = F.when(F.col("event_id") % 2 == 0, "escalated").otherwise("auto_resolved")
    return _events(spark, sf_dir, "error").filter(F.col("value") > 200).select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("alert_id"),
        _tenant(F.col("user_id"), 5).alias("model_id"),
        F.lit("Unclear root cause").alias("hypothesis"),
        (F.col("value") / 500.0).alias("confidence"),
        status.alias("status"),
        F.when(status == "escalated", "escalate").otherwise("rollback").alias("recommended_action"),
        F.lit(None).cast("string").alias("llm_explanation"),
        F.col("ts").alias("created_at"),
    )


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts per call, from the turns of each conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("explainer-"), (F.col("conv_id") % 3).cast("string")).alias("model_name"),
        F.when(F.col("role") == "user", F.length("text")).otherwise(0).cast("bigint").alias("tokens_in"),
        F.when(F.col("role") != "user", F.length("text")).otherwise(0).cast("bigint").alias("tokens_out"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600).alias("called_at"),
    )

