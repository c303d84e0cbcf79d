"""Streams over the given tables, run until everything there is was processed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.operators import drift, profile
from driftlane.operators.longform import feature_rows
from driftlane.plans.drift_queries import _STATUS, _decile_edges, _psi_sql
from driftlane.plans.incident_queries import _EVIDENCE, _TARGETS
from driftlane.plans.registry import query, stamp
from driftlane.plans.view_sql import stamp_sql
from driftlane.session import materialise, shared_folder
from driftlane.sources import driver_tables as T
from driftlane.sources import files
from driftlane.streaming import corrections, streams


def _stream(spark, sf_dir, name) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A bounded batch bounds what one key brings to the stateful operators.
    reader = spark.readStream.schema(T.SCHEMAS[name]).option("maxFilesPerTrigger", 256)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def _drain(stream: DataFrame) -> DataFrame:
    """Append the output of a stream to a table in the shared folder and read that."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    streams.run_available(writer, f"{folder}/offsets")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _alerts(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string"), F.lit(":v1")).alias("model_id"),
        F.when(F.col("event_id") % 3 == 0, "accuracy_drop").otherwise("feature_drift").alias("alert_type"),
        F.when(F.col("value") > 50, "critical").otherwise("warning").alias("severity"),
        F.col("ts").alias("triggered_at"),
    )


# A window is emitted when the watermark, ten minutes behind the newest event, has passed its end.
@query(
    "stream_hourly_volume",
    f"""
SELECT 'm' || (user_id % 5) AS model_name, {stamp_sql("date_trunc('hour', ts)")} AS hour, count(*) AS n_predictions
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
GROUP BY ALL""",
)
def stream_hourly_volume(spark, sf_dir):
    requests = _stream(spark, sf_dir, "events").select(
        F.col("ts").alias("created_at"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string"), F.lit(":v1")).alias("model_id"),
    )
    return _drain(streams.hourly_volume(requests)).withColumn("hour", stamp("hour"))


@query(
    "stream_delayed_labels",
    f"""
SELECT o.o_orderkey AS id, l_linenumber AS line, {stamp_sql("l_shipdate")} AS observed_at, l_returnflag = 'R' AS true_label
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
 AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY""",
)
def stream_delayed_labels(spark, sf_dir):
    predictions = _stream(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")
    )
    lines = _stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prediction_id"),
        F.struct((F.col("l_returnflag") == "R").alias("returned"), F.col("l_linenumber").alias("line")).alias("true_label"),
        F.col("l_shipdate").alias("observed_at"),
    )
    joined = streams.delayed_labels(predictions, lines, max_delay="30 days", lateness="1 day")
    return _drain(joined).select(
        "id", F.col("true_label.line").alias("line"), stamp("observed_at").alias("observed_at"),
        F.col("true_label.returned").alias("true_label"),
    )


@query(
    "stream_sliding_confusion",
    f"""
WITH labelled AS (SELECT p.model_id, p.prediction, l_returnflag = 'R' AS y, p.created_at,
                         CAST(floor(epoch(p.created_at) / 1296000) AS BIGINT) AS slot
   FROM preds p JOIN lineitem ON p.id = l_orderkey AND l_shipdate >= p.created_at
    AND l_shipdate <= p.created_at + INTERVAL 90 DAY),
counts AS (SELECT model_id, (slot - k) * 1296000 AS s, count(*) AS n, count(*) FILTER (prediction AND y) AS tp,
                  count(*) FILTER (prediction AND NOT y) AS fp, count(*) FILTER (NOT prediction AND y) AS fn
           FROM labelled, range(0, 4) r(k) GROUP BY ALL),
newest AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS at)
SELECT model_id, {stamp_sql("TIMESTAMP '1970-01-01' + to_seconds(s)")} AS window_start, n AS n_samples,
  round(CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END, 4) AS "precision",
  round(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 4) AS f1
FROM counts, newest WHERE n >= 5
 AND TIMESTAMP '1970-01-01' + to_seconds(s) + INTERVAL 60 DAY <= newest.at - INTERVAL 91 DAY""",
)
def stream_sliding_confusion(spark, sf_dir):
    price = F.col("o_totalprice") / T.MAX_PRICE
    predictions = _stream(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), (price >= 0.5).alias("prediction"),
        F.concat(F.lit("m"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string"), F.lit(":v1")).alias(
            "model_id"
        ),
    )
    lines = _stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prediction_id"), (F.col("l_returnflag") == "R").alias("true_label"),
        F.col("l_shipdate").alias("observed_at"),
    )
    joined = streams.delayed_labels(predictions, lines, max_delay="90 days", lateness="1 day")
    report = _drain(streams.sliding_confusion(joined, "60 days", "15 days", minimum=5))
    return report.drop("window_end").withColumn("window_start", stamp("window_start"))


def _arriving(spark, rows: DataFrame, time: str, slices: int = 4, files: int = 2) -> DataFrame:
    """A stream that delivers a table slice by slice in the order of ``time``, a few files each."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    first, last = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    part = F.least(F.floor((F.unix_micros(time) - first) * slices / (last - first + 1)), F.lit(slices - 1))
    for i in range(slices):
        rows.where(part == i).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query(
    "stream_corrected_accuracy",
    f"""
WITH labelled AS (SELECT p.model_id, p.prediction, l_returnflag = 'R' AS y, p.created_at
   FROM preds p JOIN lineitem ON p.id = l_orderkey AND l_shipdate >= p.created_at AND l_shipdate <= p.created_at + INTERVAL 90 DAY),
counts AS (SELECT model_id, CAST(floor(epoch(created_at) / 2592000) AS BIGINT) - k AS w, count(*) AS n, count(*) FILTER (prediction AND y) AS tp,
                  count(*) FILTER (prediction AND NOT y) AS fp, count(*) FILTER (NOT prediction AND y) AS fn
           FROM labelled, range(0, 2) r(k) GROUP BY ALL)
SELECT model_id, {stamp_sql("TIMESTAMP '1970-01-01' + to_seconds(w * 2592000)")} AS window_start, n AS n_samples,
  round(CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END, 4) AS "precision",
  round(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 4) AS f1
FROM counts WHERE n >= 5
 AND TIMESTAMP '1970-01-01' + to_seconds((w + 2) * 2592000) <= (SELECT max(created_at) FROM labelled) - INTERVAL 10 DAY""",
)
def stream_corrected_accuracy(spark, sf_dir):
    """Windows close ten days after their end, labels may take ninety: what is late corrects them."""
    predictions = T.predictions(spark, sf_dir).select("id", "model_id", "prediction", "created_at")
    lines = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prediction_id"), (F.col("l_returnflag") == "R").alias("true_label"),
        F.col("l_shipdate").alias("observed_at"),
    )
    joined = streams.delayed_labels(
        _arriving(spark, predictions, "created_at"), _arriving(spark, lines, "observed_at"), max_delay="90 days", lateness="1 day"
    )
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = joined.select("model_id", "created_at", "prediction", "true_label")
    streams.run_available(corrections.corrected_windows(rows, folder, "60 days", "30 days", "10 days"), f"{folder}/offsets")
    report = corrections.corrected_report(spark, folder, minimum=5)
    return report.drop("window_end", "corrected").withColumn("window_start", stamp("window_start"))


_WINDOW = "CAST(floor(epoch(created_at) / 15552000) AS BIGINT)"
_OPEN = "(SELECT CAST(floor((epoch(max(l_shipdate)) - 86400) / 15552000) AS BIGINT) FROM lineitem)"


def _windowed(rows: str, value: str) -> str:
    """All rows as current ones of their window, and the baseline rows as those of every window."""
    return f"""(SELECT model_id || '|' || {_WINDOW} AS model_id, TRUE AS is_current{value} FROM {rows} WHERE {_WINDOW} < {_OPEN}
      UNION ALL SELECT model_id || '|' || w, FALSE{value} FROM {rows},
        (SELECT DISTINCT {_WINDOW} AS w FROM feat WHERE {_WINDOW} < {_OPEN}) WHERE NOT is_current)"""


_FEATURES_AT = {
    "numeric": "(" + " UNION ALL ".join(f"SELECT model_id, is_current, created_at, '{c}' AS feature, {c} AS v FROM feat" for c in T.NUMERIC_FEATURES) + ")",
    "category": "(" + " UNION ALL ".join(f"SELECT model_id, is_current, created_at, '{c}' AS feature, {c} AS v FROM feat" for c in T.CATEGORICAL_FEATURES) + ")",
}


@query(
    "stream_window_drift",
    _psi_sql(
        _windowed(_FEATURES_AT["numeric"], ", feature, v"), _windowed(_FEATURES_AT["category"], ", feature, v"), _windowed("feat", ""),
        _decile_edges(_windowed(_FEATURES_AT["numeric"], ", feature, v")), "1",
        f"""SELECT {stamp_sql("TIMESTAMP '1970-01-01' + to_seconds(CAST(split_part(model_id, '|', 2) AS BIGINT) * 15552000)")} AS window_start,
            split_part(model_id, '|', 1) AS model_id, feature AS feature_name, psi_score, sample_size, {_STATUS} AS status
            FROM scored JOIN samples USING (model_id) WHERE sample_size > 0""",
    ),
)
def stream_window_drift(spark, sf_dir):
    before = T.feature_table(spark, sf_dir).filter(F.col("created_at") < F.lit(T.DRIFT_SPLIT))

    def long(df, keep=("model_id",)):
        return feature_rows(
            df, {c: F.col(c) for c in T.NUMERIC_FEATURES}, {c: F.col(c) for c in T.CATEGORICAL_FEATURES}, keep
        )

    baseline = long(before)
    edges = materialise(drift.edges_from_deciles(profile.numeric_profile(baseline)))
    expected = materialise(
        drift.uniform_mass(edges).unionByName(drift.category_mass(profile.category_counts(baseline)))
    )
    rows = _stream(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string"), F.lit(":v1")).alias("model_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
    )
    bins = _drain(streams.window_bins(long(rows, ("model_id", "created_at")), edges, "180 days", "1 day"))
    return streams.window_drift(bins, expected).withColumn("window_start", stamp("window_start"))


@query(
    "stream_alert_dedup",
    f"""
WITH RECURSIVE opened AS (
  SELECT model_id, min(triggered_at) AS at FROM alerts GROUP BY model_id
  UNION ALL
  SELECT o.model_id, min(a.triggered_at) FROM opened o JOIN alerts a
    ON a.model_id = o.model_id AND a.triggered_at > o.at + INTERVAL 15 MINUTE GROUP BY o.model_id, o.at)
SELECT a.model_id, a.id, a.triggered_at = o.at AS opens, {stamp_sql("o.at")} AS opened_at
FROM alerts a ASOF JOIN opened o ON a.model_id = o.model_id AND a.triggered_at >= o.at""",
)
def stream_alert_dedup(spark, sf_dir):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, streams.ROCKSDB)
    try:
        out = _drain(streams.deduplicate_alerts(_alerts(spark, sf_dir)))
    finally:
        spark.conf.set(provider, before)
    return out.select("model_id", "id", "opens", stamp("opened_at").alias("opened_at"))


@query(
    "stream_incidents",
    f"""
WITH {_EVIDENCE},{_TARGETS},
first_alerts AS (SELECT model_id, arg_min(id, (triggered_at, id)) AS id FROM alerts GROUP BY model_id),
decided AS (SELECT d.*, t.target_id, recommended_action = 'rollback' AND confidence >= 0.80 AS wanted
            FROM diagnosed d JOIN first_alerts f USING (id) LEFT JOIN targets t ON t.model_name = split_part(d.model_id, ':', 1))
SELECT id, model_id, rule_name, CASE WHEN wanted AND target_id IS NULL THEN 0.2::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN wanted AND target_id IS NULL THEN 'escalate' ELSE recommended_action END AS recommended_action,
  CASE WHEN wanted AND target_id IS NOT NULL THEN 'auto_resolved' ELSE 'escalated' END AS status FROM decided""",
)
def stream_incidents(spark, sf_dir):
    """The alerts come in four batches. An incident is dated when the job runs, so each model's first alert opens its only one."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    tables = {
        "deployments": T.deployments(spark, sf_dir), "upstream_events": T.upstream_events(spark, sf_dir),
        "drift_reports": T.drift_reports(spark, sf_dir), "accuracy_reports": T.accuracy_reports(spark, sf_dir),
    }
    for name, rows in tables.items():
        files.store_derived(rows, folder, name)

    def context(session):
        return {
            "deployments": files.read_table(session, folder, "deployments"),
            "upstream": files.read_table(session, folder, "upstream_events"),
            "drift": files.read_table(session, folder, "drift_reports"),
            "accuracy": files.read_table(session, folder, "accuracy_reports"),
        }

    alerts = _arriving(spark, T.alerts(spark, sf_dir).drop("processed"), "triggered_at")
    streams.run_available(streams.continuous_incidents(alerts, context, folder), f"{folder}/offsets")
    opened = spark.read.parquet(f"{folder}/incidents")
    return opened.select("id", "model_id", "rule_name", "confidence", "recommended_action", "status")
