"""Accuracy, label and dashboard queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftlane.functions.ids import model_name
from driftlane.operators import accuracy, dashboard
from driftlane.plans.registry import query, stamp
from driftlane.plans.view_sql import stamp_sql
from driftlane.session import shared_folder
from driftlane.sources import driver_tables as T
from driftlane.sources import files

_HOURS = 24 * 400

# Metrics of labelled rows (keys, prediction, confidence, true_label) as SQL.
_RANKED = """
ranked AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY confidence)
                     + (count(*) OVER (PARTITION BY {keys}, confidence) - 1) / 2.0::DOUBLE AS midrank FROM joined),
metrics AS (SELECT {keys}, count(*) AS n_samples,
    count(*) FILTER (prediction AND true_label) AS tp, count(*) FILTER (prediction AND NOT true_label) AS fp,
    count(*) FILTER (NOT prediction AND true_label) AS fn, count(*) FILTER (true_label) AS p,
    count(*) FILTER (NOT true_label) AS q, sum(midrank) FILTER (true_label) AS ranks
  FROM ranked GROUP BY {keys})"""
_VALUES = """
    round(CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END, 4) AS "precision",
    round(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END, 4) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 4) AS f1,
    round(CASE WHEN p = 0 OR q = 0 THEN 0.5::DOUBLE
          ELSE (ranks - p::DOUBLE * (p + 1) / 2) / (p::DOUBLE * q) END, 4) AS roc_auc"""


def metrics_sql(joined: str, keys: str, select: str) -> str:
    return f"WITH joined AS ({joined}),{_RANKED.format(keys=keys)}\n{select}"


_RECENT = f"""SELECT p.model_id, p.prediction, p.confidence, o.true_label
    FROM preds p JOIN outs o ON p.id = o.prediction_id
    WHERE p.created_at >= TIMESTAMP '2001-08-02' - to_hours({_HOURS})"""


def _accuracy(spark, sf_dir):
    return accuracy.accuracy_report(
        T.predictions(spark, sf_dir), T.outcomes(spark, sf_dir), T.PREDICTIONS_AS_OF, hours=_HOURS
    )


@query(
    "accuracy_report",
    metrics_sql(_RECENT, "model_id", f"SELECT model_id, n_samples, {_VALUES} FROM metrics WHERE n_samples >= 30"),
)
def accuracy_report(spark, sf_dir):
    return _accuracy(spark, sf_dir).select("model_id", "n_samples", "precision", "recall", "f1", "roc_auc")


@query(
    "accuracy_report_partial_labels",
    metrics_sql(
        """SELECT p.model_id, p.prediction, p.confidence, o.true_label
           FROM doc_preds p JOIN doc_outs o ON p.id = o.prediction_id""",
        "model_id",
        f"SELECT model_id, n_samples, {_VALUES} FROM metrics",
    ),
)
def accuracy_report_partial_labels(spark, sf_dir):
    joined = accuracy.labelled(T.document_predictions(spark, sf_dir), T.document_outcomes(spark, sf_dir))
    metrics = accuracy.classification_metrics(joined, ["model_id"])
    return metrics.select(
        "model_id", "n_samples", *[F.round(m, 4).alias(m) for m in ("precision", "recall", "f1", "roc_auc")]
    )




@query(
    "accuracy_drop_alerts",
    f"""
WITH joined AS ({_RECENT}),{_RANKED.format(keys="model_id")},
base AS (SELECT p.model_id, count(*) FILTER (prediction AND true_label) AS tp,
                count(*) FILTER (prediction AND NOT true_label) AS fp,
                count(*) FILTER (NOT prediction AND true_label) AS fn
         FROM preds p JOIN outs o ON p.id = o.prediction_id WHERE NOT p.is_current GROUP BY p.model_id),
compared AS (SELECT m.model_id, m.n_samples, 2.0::DOUBLE * m.tp / (2 * m.tp + m.fp + m.fn) AS f1,
                    round(2.0::DOUBLE * b.tp / (2 * b.tp + b.fp + b.fn), 4) + 0.15::DOUBLE AS baseline_f1
             FROM metrics m JOIN base b USING (model_id) WHERE m.n_samples >= 30)
SELECT model_id, 'accuracy_drop' AS alert_type, 'critical' AS severity, round(f1, 4) AS current_f1,
       round(baseline_f1, 4) AS baseline_f1, round(baseline_f1 - f1, 4) AS "drop", n_samples
FROM compared WHERE baseline_f1 > 0 AND baseline_f1 - f1 >= 0.15::DOUBLE""",
)
def accuracy_drop_alerts(spark, sf_dir):
    before = T.predictions(spark, sf_dir).filter(F.col("created_at") < F.lit(T.PREDICTION_SPLIT))
    trained = accuracy.classification_metrics(accuracy.labelled(before, T.outcomes(spark, sf_dir)), ["model_id"])
    # Saved as version 1 with other values first: the check loads the newest version.
    store = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    newest = F.concat(model_name(F.col("model_id")), F.lit(":v"))
    saved = trained.select("model_id", "n_samples", "precision", "recall", (F.round("f1", 4) + 0.15).alias("f1"), "roc_auc")
    files.save_baseline(store, metrics=saved.withColumn("f1", F.lit(0.0)))
    files.save_baseline(store, metrics=saved.withColumn("model_id", F.concat(newest, F.lit("12"))))
    loaded = files.load_newest(spark, store, "metrics").withColumn("model_id", F.concat(newest, F.lit("1")))
    alerts = accuracy.accuracy_alerts(_accuracy(spark, sf_dir), loaded)
    return alerts.select("model_id", "alert_type", "severity", "current_f1", "baseline_f1", "drop", "n_samples")


@query(
    "accuracy_sliding_windows",
    metrics_sql(
        """SELECT p.model_id, p.prediction, p.confidence, o.true_label, w.s AS window_start
           FROM (SELECT *, CAST(floor(epoch(created_at) / 1296000) AS BIGINT) AS slot FROM preds) p
           JOIN outs o ON p.id = o.prediction_id
           CROSS JOIN LATERAL (SELECT (p.slot - k) * 1296000 AS s FROM range(0, 4) r(k)) w""",
        "model_id, window_start",
        f"""SELECT model_id, {stamp_sql("TIMESTAMP '1970-01-01' + to_seconds(window_start)")} AS window_start,
            n_samples, {_VALUES} FROM metrics WHERE n_samples >= 30""",
    ),
)
def accuracy_sliding_windows(spark, sf_dir):
    report = accuracy.sliding_accuracy(
        T.predictions(spark, sf_dir), T.outcomes(spark, sf_dir), window="60 days", slide="15 days"
    )
    return report.select(
        "model_id", stamp("window_start").alias("window_start"), "n_samples", "precision", "recall", "f1", "roc_auc"
    )


@query(
    "label_coverage",
    """
SELECT p.model_id, count(p.id) AS n_predictions, count(p.id) FILTER (o.prediction_id IS NOT NULL) AS n_labelled,
       count(p.id) FILTER (o.prediction_id IS NULL) AS n_unlabelled,
       count(o.prediction_id) FILTER (p.id IS NULL) AS n_orphan_labels
FROM preds p FULL OUTER JOIN (SELECT 2 * prediction_id AS prediction_id FROM outs) o ON p.id = o.prediction_id
GROUP BY p.model_id""",
)
def label_coverage(spark, sf_dir):
    # Labels from a system that counts in twos: some predictions have none, some labels no prediction.
    labels = T.outcomes(spark, sf_dir).withColumn("prediction_id", F.col("prediction_id") * 2)
    return accuracy.label_coverage(T.predictions(spark, sf_dir), labels)


@query(
    "label_latency",
    """
SELECT model_id, count(*) AS n_labels, round(avg(delay_seconds), 4) AS mean_intended,
       round(avg(latency), 4) AS mean_observed, round(quantile_cont(latency, 0.5), 4) AS p50_observed,
       round(quantile_cont(latency, 0.95), 4) AS p95_observed
FROM (SELECT p.model_id, o.delay_seconds, (epoch_us(o.observed_at) - epoch_us(p.created_at)) / 1e6::DOUBLE AS latency
      FROM preds p JOIN outs o ON p.id = o.prediction_id) GROUP BY model_id""",
)
def label_latency(spark, sf_dir):
    return accuracy.label_latency(T.predictions(spark, sf_dir), T.outcomes(spark, sf_dir))


@query(
    "labelled_training_extract",
    f"""
SELECT p.id, p.model_id, split_part(p.model_id, ':', 1) AS model_name, {stamp_sql("p.created_at")} AS created_at,
       p.price, CAST(p.segment AS DOUBLE) AS segment, p.status, CAST(o.true_label AS INT) AS label
FROM preds p JOIN outs o ON p.id = o.prediction_id""",
)
def labelled_training_extract(spark, sf_dir):
    rows = accuracy.labelled_training_rows(
        T.predictions(spark, sf_dir), T.outcomes(spark, sf_dir),
        {"price": "double", "segment": "double", "status": "string"},
    )
    return rows.withColumn("created_at", stamp("created_at"))


@query(
    "trailing_window_counts",
    """
SELECT split_part(model_id, ':', 1) AS model_name, split_part(model_id, ':', 2) AS version, count(*) AS n_alerts,
       count(*) FILTER (alert_type = 'accuracy_drop') AS n_accuracy_drops
FROM alerts WHERE triggered_at >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR GROUP BY ALL""",
)
def trailing_window_counts(spark, sf_dir):
    from driftlane.functions.ids import model_name, model_version

    recent = T.alerts(spark, sf_dir).filter(F.col("triggered_at") >= accuracy.since(T.EVENTS_AS_OF, 48))
    return recent.groupBy(
        model_name(F.col("model_id")).alias("model_name"), model_version(F.col("model_id")).alias("version")
    ).agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.count_if(F.col("alert_type") == "accuracy_drop").alias("n_accuracy_drops"),
    )


@query(
    "trailing_window_fractional",
    """
SELECT split_part(model_id, ':', 1) AS model_name, count(*) AS n_alerts
FROM alerts WHERE triggered_at >= TIMESTAMP '2024-01-31' - INTERVAL 5430 SECOND GROUP BY ALL
UNION ALL
SELECT 'half an hour', count(*) FROM alerts WHERE triggered_at >= TIMESTAMP '2024-01-31' - INTERVAL 1800 SECOND""",
)
def trailing_window_fractional(spark, sf_dir):
    """Windows of parts of an hour."""
    from driftlane.functions.ids import model_name

    alerts = T.alerts(spark, sf_dir)
    longer = alerts.filter(F.col("triggered_at") >= accuracy.since(T.EVENTS_AS_OF, 5430 / 3600))
    shorter = alerts.filter(F.col("triggered_at") >= accuracy.since(T.EVENTS_AS_OF, 0.5))
    counted = longer.groupBy(model_name(F.col("model_id")).alias("model_name")).agg(F.count(F.lit(1)).alias("n_alerts"))
    return counted.unionByName(shorter.agg(F.lit("half an hour").alias("model_name"), F.count(F.lit(1)).alias("n_alerts")))


@query(
    "available_models",
    """
SELECT DISTINCT CASE WHEN model_id LIKE '%:%' THEN split_part(model_id, ':', 1) ELSE model_id END AS model_name
FROM (SELECT model_id FROM deploys UNION ALL SELECT model_id FROM doc_preds)
UNION SELECT 'churn-model' UNION SELECT 'fraud-model'""",
)
def available_models(spark, sf_dir):
    return dashboard.available_models(T.deployments(spark, sf_dir), T.document_predictions(spark, sf_dir))


@query(
    "kpi_cards",
    """
WITH latest AS (SELECT DISTINCT ON (split_part(model_id, ':', 1)) split_part(model_id, ':', 1) AS model_name, version,
                       status, traffic_percentage
                FROM deploys ORDER BY split_part(model_id, ':', 1), deployed_at DESC, id DESC),
pc AS (SELECT split_part(model_id, ':', 1) AS model_name, count(*) AS n FROM preds GROUP BY 1),
ac AS (SELECT split_part(model_id, ':', 1) AS model_name, count(*) AS n FROM alerts GROUP BY 1),
ic AS (SELECT split_part(model_id, ':', 1) AS model_name, count(*) AS n FROM incidents
       WHERE status IN ('investigating', 'escalated') GROUP BY 1)
SELECT model_name, coalesce(version, 'N/A') AS active_version, coalesce(status, 'Unknown') AS status,
       CASE WHEN version IS NULL THEN 0.0::DOUBLE ELSE coalesce(nullif(traffic_percentage, 0.0), 100.0::DOUBLE) END
         AS traffic_percentage,
       coalesce(pc.n, 0) AS total_predictions, coalesce(ac.n, 0) AS alerts, coalesce(ic.n, 0) AS open_incidents
FROM latest FULL JOIN pc USING (model_name) FULL JOIN ac USING (model_name) FULL JOIN ic USING (model_name)""",
)
def kpi_cards(spark, sf_dir):
    return dashboard.kpi_cards(
        T.deployments(spark, sf_dir), T.predictions(spark, sf_dir), T.alerts(spark, sf_dir), T.incidents(spark, sf_dir)
    )


@query(
    "deployment_history",
    f"""
SELECT model_id, version, status, traffic_percentage, rejection_reason, {stamp_sql("deployed_at")} AS deployed_at,
       {stamp_sql("promoted_at")} AS promoted_at FROM deploys""",
)
def deployment_history(spark, sf_dir):
    return (
        dashboard.deployment_history(T.deployments(spark, sf_dir))
        .withColumn("deployed_at", stamp("deployed_at"))
        .withColumn("promoted_at", stamp("promoted_at"))
    )


@query(
    "drift_history_of_tenant",
    f"""
SELECT model_id, feature_name, round(psi_score, 6) AS psi_score, status, sample_size,
       {stamp_sql("checked_at")} AS checked_at FROM drifts WHERE model_id LIKE 'm1%'""",
)
def drift_history_of_tenant(spark, sf_dir):
    rows = dashboard.drift_history(dashboard.for_tenant(T.drift_reports(spark, sf_dir), "m1", prefix=True))
    return rows.withColumn("checked_at", stamp("checked_at")).withColumn("psi_score", F.round("psi_score", 6))


@query(
    "accuracy_history",
    f"""
SELECT model_id, n_samples AS sample_size, round("precision", 6) AS "precision", round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc, {stamp_sql("created_at")} AS checked_at FROM accuracies""",
)
def accuracy_history(spark, sf_dir):
    rows = dashboard.accuracy_history(T.accuracy_reports(spark, sf_dir))
    return rows.select(
        "model_id", "sample_size", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1", "roc_auc")],
        stamp("checked_at").alias("checked_at"),
    )


@query(
    "incident_history",
    f"""
SELECT id, model_id, hypothesis, round(confidence, 6) AS confidence, status, recommended_action AS action_taken,
       llm_explanation, {stamp_sql("created_at")} AS created_at FROM incidents""",
)
def incident_history(spark, sf_dir):
    rows = dashboard.incident_history(T.incidents(spark, sf_dir))
    return rows.withColumn("created_at", stamp("created_at")).withColumn("confidence", F.round("confidence", 6))


@query(
    "prediction_timeline", f"SELECT {stamp_sql('created_at')} AS created_at, model_id FROM preds"
)
def prediction_timeline(spark, sf_dir):
    return dashboard.prediction_timeline(T.predictions(spark, sf_dir)).withColumn("created_at", stamp("created_at"))


@query(
    "hourly_volume",
    f"""
WITH counts AS (SELECT split_part(model_id, ':', 1) AS model_name, date_trunc('hour', triggered_at) AS hour,
                       count(*) AS n FROM alerts GROUP BY 1, 2),
spans AS (SELECT model_name, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
          FROM counts GROUP BY model_name)
SELECT s.model_name, {stamp_sql("s.hour")} AS hour, coalesce(c.n, 0) AS n_predictions
FROM spans s LEFT JOIN counts c ON s.model_name = c.model_name AND s.hour = c.hour""",
)
def hourly_volume(spark, sf_dir):
    requests = T.alerts(spark, sf_dir).select("model_id", F.col("triggered_at").alias("created_at"))
    return dashboard.hourly_volume(requests).withColumn("hour", stamp("hour"))


_PIVOT_FEATURES = ("_prediction", "f0", "f1", "f2", "f3", "f4")


@query(
    "psi_pivot_filled",
    f"""
WITH cells AS (SELECT split_part(model_id, ':', 1) AS model_name, checked_at,
  {", ".join(f"arg_max(psi_score, id) FILTER (feature_name = '{f}') AS {f}" for f in _PIVOT_FEATURES)}
  FROM drifts GROUP BY 1, 2)
SELECT model_name, {stamp_sql("checked_at")} AS checked_at,
  {", ".join(f"round(last_value({f} IGNORE NULLS) OVER w, 6) AS {f}" for f in _PIVOT_FEATURES)}
FROM cells WINDOW w AS (PARTITION BY model_name ORDER BY cells.checked_at)""",
)
def psi_pivot_filled(spark, sf_dir):
    wide = dashboard.psi_pivot(T.drift_reports(spark, sf_dir), _PIVOT_FEATURES)
    return wide.select(
        "model_name", stamp("checked_at").alias("checked_at"), *[F.round(f, 6).alias(f) for f in _PIVOT_FEATURES]
    )


@query(
    "metric_series_filled",
    f"""
SELECT split_part(model_id, ':', 1) AS model_name, id, {stamp_sql("created_at")} AS checked_at,
       round(last_value(f1 IGNORE NULLS) OVER w, 6) AS f1,
       round(last_value("precision" IGNORE NULLS) OVER w, 6) AS "precision",
       round(last_value(roc_auc IGNORE NULLS) OVER w, 6) AS roc_auc
FROM accuracies WINDOW w AS (PARTITION BY model_id ORDER BY created_at, id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def metric_series_filled(spark, sf_dir):
    rows = dashboard.metric_series(T.accuracy_reports(spark, sf_dir))
    return rows.select(
        "model_name", "id", stamp("checked_at").alias("checked_at"),
        *[F.round(m, 6).alias(m) for m in ("f1", "precision", "roc_auc")],
    )


@query(
    "first_features_selection",
    """
WITH names AS (SELECT DISTINCT split_part(model_id, ':', 1) AS model_name, feature_name FROM drifts),
chosen AS (SELECT * FROM names QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY feature_name) <= 5)
SELECT c.model_name, d.feature_name, count(*) AS n_reports, round(max(d.psi_score), 6) AS max_psi
FROM drifts d JOIN chosen c ON split_part(d.model_id, ':', 1) = c.model_name AND d.feature_name = c.feature_name
GROUP BY 1, 2""",
)
def first_features_selection(spark, sf_dir):
    return (
        dashboard.first_features(T.drift_reports(spark, sf_dir))
        .groupBy("model_name", "feature_name")
        .agg(F.count(F.lit(1)).alias("n_reports"), F.round(F.max("psi_score"), 6).alias("max_psi"))
    )


@query(
    "latest_deployments",
    """
SELECT DISTINCT ON (split_part(model_id, ':', 1)) split_part(model_id, ':', 1) AS model_name, version, status,
       traffic_percentage, model_id, id
FROM deploys ORDER BY split_part(model_id, ':', 1), deployed_at DESC, id DESC""",
)
def latest_deployments(spark, sf_dir):
    rows = dashboard.named(T.deployments(spark, sf_dir))
    return dashboard.latest_deployment(rows).select("model_name", "latest.*")


@query(
    "token_spend_per_day",
    """
SELECT model_name, strftime(called_at, '%Y-%m-%d') AS day, count(*) AS n_calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
       CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
       round(sum(round((tokens_in * 0.59::DOUBLE + tokens_out * 0.79::DOUBLE) / 1e6::DOUBLE, 6)), 6) AS cost_estimate
FROM token_calls GROUP BY 1, 2""",
)
def token_spend_per_day(spark, sf_dir):
    return dashboard.token_spend(T.token_usage(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))
