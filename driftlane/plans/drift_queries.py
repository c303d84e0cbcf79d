"""Drift, baseline profiles and null rates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlane.operators import drift, profile
from driftlane.operators.longform import feature_rows, payload_entries, payload_rows
from driftlane.plans.registry import query
from driftlane.session import materialise
from driftlane.sources import driver_tables as T


def _features(spark, sf_dir):
    df = T.feature_table(spark, sf_dir).withColumn("is_current", F.col("created_at") >= F.lit(T.DRIFT_SPLIT))
    return feature_rows(
        df,
        {name: F.col(name) for name in T.NUMERIC_FEATURES},
        {name: F.col(name) for name in T.CATEGORICAL_FEATURES},
        keep=("model_id", "is_current"),
    )


def _payloads(spark, sf_dir, current):
    split = F.lit(T.PREDICTION_SPLIT)
    df = T.predictions(spark, sf_dir)
    df = df.filter(F.col("created_at") >= split if current else F.col("created_at") < split)
    return payload_rows(df, ("price", "segment"), ("status",))


# One baseline/current pair of bin counts -> PSI, as SQL. ``edged`` gives the inner
# cut points per model and feature, ``mass`` the expected weight per bin.
_PSI_FROM_BINS = """
totals AS (SELECT *, sum(b) OVER g AS tb, sum(c) OVER g AS tc FROM bins WINDOW g AS (PARTITION BY model_id, feature)),
smooth AS (SELECT *, CASE WHEN b = 0 THEN 1e-4::DOUBLE ELSE b / tb END AS e0,
                     CASE WHEN c = 0 THEN 1e-4::DOUBLE ELSE c / tc END AS a0 FROM totals WHERE tb > 0),
shares AS (SELECT *, e0 / sum(e0) OVER g AS e, a0 / sum(a0) OVER g AS a FROM smooth
           WINDOW g AS (PARTITION BY model_id, feature)),
scored AS (SELECT model_id, feature, CASE WHEN max(tc) = 0 THEN 0.0::DOUBLE
                  ELSE greatest(0.0::DOUBLE, round(sum((a - e) * ln(a / e)), 6)) END AS psi_score
           FROM shares GROUP BY model_id, feature)"""

_STATUS = """CASE WHEN sample_size < 30 THEN 'insufficient_data' WHEN psi_score < 0.10 THEN 'stable'
                  WHEN psi_score < 0.25 THEN 'moderate' ELSE 'significant' END"""


def _psi_sql(numeric: str, category: str, wide: str, edged: str, mass: str, select: str) -> str:
    return f"""
WITH quants AS ({edged}),
edged AS (SELECT model_id, feature, CASE WHEN len(d) > 2 THEN d[2:len(d) - 1] ELSE [] END AS cuts
          FROM (SELECT model_id, feature, list_sort(list_distinct(q)) AS d FROM quants)),
each_bin AS (SELECT model_id, feature, CAST(unnest(range(0, len(cuts) + 1)) AS VARCHAR) AS bin, cuts FROM edged),
placed AS (SELECT n.model_id, n.feature, n.is_current,
                  CAST(len(list_filter(e.cuts, lambda x: x <= n.v)) AS VARCHAR) AS bin
           FROM {numeric} n JOIN edged e USING (model_id, feature) WHERE n.v IS NOT NULL),
counted AS (SELECT model_id, feature, bin, count(*) FILTER (NOT is_current) AS nb, count(*) FILTER (is_current) AS nc
            FROM placed GROUP BY ALL),
bins AS (SELECT x.model_id, x.feature, x.bin, CAST({mass} AS DOUBLE) AS b, CAST(coalesce(k.nc, 0) AS DOUBLE) AS c
         FROM each_bin x LEFT JOIN counted k USING (model_id, feature, bin)
         UNION ALL
         SELECT model_id, feature, v, CAST(count(*) FILTER (NOT is_current) AS DOUBLE),
                CAST(count(*) FILTER (is_current) AS DOUBLE) FROM {category} WHERE v IS NOT NULL GROUP BY ALL),
{_PSI_FROM_BINS},
samples AS (SELECT model_id, count(*) FILTER (is_current) AS sample_size FROM {wide} GROUP BY model_id),
report AS (SELECT model_id, feature AS feature_name, psi_score, sample_size, {_STATUS} AS status
           FROM scored JOIN samples USING (model_id) WHERE sample_size >= 30
           UNION ALL
           SELECT model_id, '_all_features', 0.0::DOUBLE, sample_size, 'insufficient_data'
           FROM samples WHERE sample_size < 30)
{select}"""


_REPORT_COLUMNS = ("model_id", "feature_name", "psi_score", "sample_size", "status")
_REPORT = "SELECT model_id, feature_name, psi_score, sample_size, status FROM report"
_ELEVEN = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"
_NINE = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"
_RAW_EDGES = f"""SELECT model_id, feature, quantile_cont(v, {_ELEVEN}) AS q
                 FROM feat_numeric WHERE NOT is_current GROUP BY ALL"""


def _decile_edges(numeric: str) -> str:
    return f"""SELECT model_id, feature, list_transform(quantile_cont(v, {_NINE}), lambda x: round(x, 4)) AS q
               FROM {numeric} WHERE NOT is_current AND v IS NOT NULL GROUP BY ALL"""


RAW_SQL = _psi_sql("feat_numeric", "feat_category", "feat", _RAW_EDGES, "coalesce(k.nb, 0)", _REPORT)


@query("drift_report_raw_baseline", RAW_SQL)
def drift_report_raw_baseline(spark, sf_dir):
    report = drift.drift_report_from_rows(_features(spark, sf_dir), T.PREDICTIONS_AS_OF)
    return report.select(*_REPORT_COLUMNS)


_TWENTIETHS = "[" + ",".join(f"{i / 20}" for i in range(21)) + "]"


@query("drift_report_twenty_bins", RAW_SQL.replace(_ELEVEN, _TWENTIETHS))
def drift_report_twenty_bins(spark, sf_dir):
    report = drift.drift_report_from_rows(_features(spark, sf_dir), T.PREDICTIONS_AS_OF, bins=20)
    return report.select(*_REPORT_COLUMNS)


SNAPSHOT_SQL = _psi_sql("preds_numeric", "preds_category", "preds", _decile_edges("preds_numeric"), "1", _REPORT)


def _snapshot_report(spark, sf_dir):
    baseline = _payloads(spark, sf_dir, current=False)
    stored = materialise(profile.numeric_profile(baseline))
    edges = drift.edges_from_deciles(stored)
    counts = profile.category_counts(baseline.filter("category IS NOT NULL"))
    expected = drift.uniform_mass(edges).unionByName(drift.category_mass(counts))
    current = _payloads(spark, sf_dir, current=True)
    return drift.drift_report(current, edges, expected, T.PREDICTIONS_AS_OF), stored


@query("drift_report_stored_deciles", SNAPSHOT_SQL)
def drift_report_stored_deciles(spark, sf_dir):
    return _snapshot_report(spark, sf_dir)[0].select(*_REPORT_COLUMNS)


def _sql_points(template: str) -> str:
    """A stored profile rounded as the snapshot is, then cut points from it."""
    return f"""SELECT model_id, feature, {template} AS q FROM (
      SELECT model_id, feature, round(median(v), 4) AS med,
             CASE WHEN round(stddev_samp(v), 4) = 0 THEN 1.0::DOUBLE ELSE round(stddev_samp(v), 4) END AS sd,
             list_transform(quantile_cont(v, {_NINE}), lambda x: round(x, 4)) AS dec
      FROM feat_numeric WHERE NOT is_current GROUP BY ALL)"""


def _stored_baseline(spark, sf_dir):
    rows = _features(spark, sf_dir)
    baseline = rows.filter("NOT is_current").drop("is_current")
    current = rows.filter("is_current").drop("is_current")
    stored = materialise(profile.numeric_profile(baseline))
    return stored, drift.category_mass(profile.category_counts(baseline)), current


SIGMA_POINTS = "list_transform(range(0, 11), lambda i: med - 3.0::DOUBLE * sd + (6.0::DOUBLE * i / 10) * sd)"


@query(
    "drift_report_sigma_edges",
    _psi_sql("feat_numeric", "feat_category", "feat", _sql_points(SIGMA_POINTS), "1", _REPORT),
)
def drift_report_sigma_edges(spark, sf_dir):
    stored, categories, current = _stored_baseline(spark, sf_dir)
    edges = drift.edges_from_sigma(stored)
    expected = drift.uniform_mass(edges).unionByName(categories)
    return drift.drift_report(current, edges, expected, T.PREDICTIONS_AS_OF).select(*_REPORT_COLUMNS)


_TRUE_MASS = """(SELECT (CASE WHEN CAST(x.bin AS INT) >= len(x.cuts) THEN 10
    ELSE len(list_filter(q.q, lambda d: d <= x.cuts[CAST(x.bin AS INT) + 1])) - 1 END
  - CASE WHEN x.bin = '0' THEN 0 ELSE len(list_filter(q.q, lambda d: d <= x.cuts[CAST(x.bin AS INT)])) - 1 END) / 10.0::DOUBLE
  FROM quants q WHERE q.model_id = x.model_id AND q.feature = x.feature)"""


@query(
    "drift_report_calibrated",
    _psi_sql(
        "feat_numeric", "feat_category", "feat",
        _sql_points("list_concat(['-inf'::DOUBLE], dec, ['inf'::DOUBLE])"), _TRUE_MASS, _REPORT,
    ),
)
def drift_report_calibrated(spark, sf_dir):
    stored, categories, current = _stored_baseline(spark, sf_dir)
    expected = drift.decile_mass(stored).unionByName(categories)
    report = drift.drift_report(current, drift.edges_between_deciles(stored), expected, T.PREDICTIONS_AS_OF)
    return report.select(*_REPORT_COLUMNS)


@query(
    "drift_alerts",
    _psi_sql(
        "preds_numeric", "preds_category", "preds", _decile_edges("preds_numeric"), "1",
        """,means AS (SELECT model_id, feature AS feature_name, round(avg(v) FILTER (NOT is_current), 4) AS baseline_mean,
             avg(v) FILTER (is_current) AS current_mean FROM preds_numeric GROUP BY ALL)
           SELECT r.model_id, CASE WHEN r.feature_name = '_prediction' THEN 'prediction_drift' ELSE 'feature_drift' END
             AS alert_type, CASE WHEN r.status = 'significant' THEN 'critical' ELSE 'warning' END AS severity,
             r.feature_name, r.psi_score, m.baseline_mean, round(m.current_mean, 4) AS current_mean
           FROM report r LEFT JOIN means m USING (model_id, feature_name)
           WHERE r.status IN ('moderate', 'significant')""",
    ),
)
def drift_alerts(spark, sf_dir):
    report, stored = _snapshot_report(spark, sf_dir)
    return drift.drift_alerts(report, stored).select(
        "model_id", "alert_type", "severity", "feature_name", "psi_score", "baseline_mean",
        F.round("current_mean", 4).alias("current_mean"),
    )


@query(
    "baseline_numeric_profile",
    f"""
SELECT model_id, feature, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(median(v), 4) AS median,
       round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.75), 4) AS p75,
       array_to_string(list_transform(quantile_cont(v, {_NINE}), lambda x: printf('%.4f', round(x, 4))), ',') AS deciles,
       count(*) FILTER (v IS NULL) AS n_missing
FROM (SELECT * FROM feat_numeric UNION ALL SELECT model_id, is_current, 'paid_tax', paid_tax FROM feat)
WHERE NOT is_current GROUP BY ALL""",
)
def baseline_numeric_profile(spark, sf_dir):
    df = T.feature_table(spark, sf_dir).filter(F.col("created_at") < F.lit(T.DRIFT_SPLIT))
    rows = feature_rows(df, {c: F.col(c) for c in (*T.NUMERIC_FEATURES, "paid_tax")}, {})
    stored = profile.numeric_profile(rows)
    texts = F.transform("deciles", lambda d: F.format_string("%.4f", d))
    return stored.withColumn("deciles", F.array_join(texts, ","))


@query(
    "baseline_category_counts",
    """SELECT model_id, feature, v AS category, count(*) AS cnt FROM feat_category WHERE NOT is_current GROUP BY ALL""",
)
def baseline_category_counts(spark, sf_dir):
    rows = _features(spark, sf_dir).filter("NOT is_current")
    return profile.category_counts(rows).select("model_id", "feature", "category", "cnt")


@query(
    "baseline_categorical_profile",
    """
SELECT model_id, feature, count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_missing,
       count(DISTINCT coalesce(v, 'nan')) AS n_unique
FROM (SELECT model_id, 'status' AS feature, nullif(status, 'P') AS v FROM preds WHERE NOT is_current) GROUP BY ALL""",
)
def baseline_categorical_profile(spark, sf_dir):
    df = T.predictions(spark, sf_dir).filter(F.col("created_at") < F.lit(T.PREDICTION_SPLIT))
    status = F.nullif(F.get_json_object("input_features", "$.status"), F.lit("P"))
    return profile.categorical_profile(feature_rows(df, {}, {"status": status}))


@query(
    "baseline_prediction_profile",
    f"""
SELECT model_id, round(avg(confidence), 4) AS mean_confidence, round(avg(CAST(prediction AS INT)), 4) AS positive_class_ratio,
       array_to_string(list_transform(quantile_cont(confidence, {_NINE}), lambda x: printf('%.4f', round(x, 4))), ',')
         AS deciles
FROM preds WHERE NOT is_current GROUP BY model_id""",
)
def baseline_prediction_profile(spark, sf_dir):
    df = T.predictions(spark, sf_dir).filter(F.col("created_at") < F.lit(T.PREDICTION_SPLIT))
    texts = F.transform("deciles", lambda d: F.format_string("%.4f", d))
    return profile.prediction_profile(df).withColumn("deciles", F.array_join(texts, ","))


@query(
    "null_rates",
    """
WITH rates AS (SELECT model_id, feature, avg(CAST(v IS NULL AS INT)) FILTER (is_current) AS cur,
                      avg(CAST(v IS NULL AS INT)) FILTER (NOT is_current) AS base
  FROM (SELECT model_id, is_current, 'paid_tax' AS feature,
               CASE WHEN is_current AND quantity > 40 THEN NULL ELSE CAST(paid_tax AS VARCHAR) END AS v FROM feat
        UNION ALL SELECT model_id, is_current, 'returnflag', nullif(returnflag, 'R') FROM feat) GROUP BY ALL)
SELECT model_id, feature, round(cur, 6) AS current_rate, round(base, 6) AS baseline_rate,
       cur - coalesce(base, 0) > 0.05::DOUBLE AS high_null_rate FROM rates WHERE cur IS NOT NULL""",
)
def null_rates(spark, sf_dir):
    df = T.feature_table(spark, sf_dir).withColumn("is_current", F.col("created_at") >= F.lit(T.DRIFT_SPLIT))
    lost = F.when(~(F.col("is_current") & (F.col("quantity") > 40)), F.col("paid_tax"))
    rows = feature_rows(
        df, {"paid_tax": lost}, {"returnflag": F.nullif("returnflag", F.lit("R"))}, keep=("model_id", "is_current")
    )
    return profile.null_rates(rows.filter("is_current"), rows.filter("NOT is_current"))


@query(
    "payload_fields",
    """
SELECT model_id, feature, count(*) AS n, count(TRY_CAST(v AS DOUBLE)) AS n_numeric FROM (
  SELECT model_id, 'price' AS feature, CAST(price AS VARCHAR) AS v FROM preds
  UNION ALL SELECT model_id, 'segment', CAST(segment AS VARCHAR) FROM preds WHERE segment IS NOT NULL
  UNION ALL SELECT model_id, 'status', status FROM preds) GROUP BY ALL""",
)
def payload_fields(spark, sf_dir):
    entries = payload_entries(T.predictions(spark, sf_dir))
    return entries.groupBy("model_id", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.col("text").try_cast("double")).alias("n_numeric")
    )
