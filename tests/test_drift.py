import json

import numpy as np
import pytest
from conftest import NOW, ago
from pyspark.sql import functions as F

from driftlane.operators import drift, profile
from driftlane.operators.longform import feature_rows, payload_rows


def psi_of_counts(expected, actual):
    e, a = np.asarray(expected, float), np.asarray(actual, float)
    e, a = e / e.sum(), a / a.sum()
    e, a = np.where(e == 0, 1e-4, e), np.where(a == 0, 1e-4, a)
    e, a = e / e.sum(), a / a.sum()
    return max(0.0, round(float(((a - e) * np.log(a / e)).sum()), 6))


def long(spark, cases):
    """cases: model -> (baseline values, current values), numeric or text."""
    rows = []
    for model, sides in cases.items():
        for current, values in zip((False, True), sides):
            rows += [
                (model, current, None if isinstance(v, str) else float(v), v if isinstance(v, str) else None)
                for v in values
            ]
    df = spark.createDataFrame(rows, "model_id string, is_current boolean, x double, c string")
    numeric, text = df.filter("c IS NULL"), df.filter("c IS NOT NULL")
    keep = ("model_id", "is_current")
    return feature_rows(numeric, {"x": F.col("x")}, {}, keep).unionByName(
        feature_rows(text, {}, {"c": F.col("c")}, keep)
    )


def test_raw_baseline_scores(spark):
    g = np.random.default_rng(0)
    base = g.normal(30, 10, 1000)
    cases = {
        "same": (base, g.normal(30, 10, 1000)),
        "shift": (g.normal(30, 5, 1000), g.normal(70, 5, 1000)),
        "constant": ([50.0] * 100, [50.0] * 100),
        "cat_same": (["a", "b"] * 500, ["a", "b"] * 500),
        "cat_skew": (["a", "b"] * 500, ["a"] * 950 + ["b"] * 50),
        "cat_missing": (["a"] * 300 + ["b"] * 400 + ["c"] * 300, ["a"] * 500 + ["b"] * 500),
        "cat_new": (["a"] * 100, ["a"] * 50 + ["z"] * 50),
        "few": (base, g.normal(30, 10, 10)),
        "gone": (base, []),
    }
    report = {
        r.model_id: r for r in drift.drift_report_from_rows(long(spark, cases), NOW).collect()
    }
    score = {m: r.psi_score for m, r in report.items()}
    assert score["same"] < 0.05 and score["shift"] > 0.5 and score["constant"] == 0.0
    assert score["cat_same"] < 0.01 and score["cat_skew"] > 0.5
    assert score["cat_missing"] == psi_of_counts([300, 400, 300], [500, 500, 0]) > 0.1
    assert score["cat_new"] == psi_of_counts([100, 0], [50, 50])
    for m in ("few", "gone"):
        assert (report[m].feature_name, report[m].status, score[m]) == ("_all_features", "insufficient_data", 0.0)
    assert report["few"].sample_size == 10 and report["gone"].sample_size == 0

    base, now = np.asarray(cases["same"][0]), np.asarray(cases["same"][1])
    edges = np.unique(np.percentile(base, np.linspace(0, 100, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    assert score["same"] == psi_of_counts(np.histogram(base, edges)[0], np.histogram(now, edges)[0])


def test_stored_deciles_and_their_null_effect(spark):
    values = np.arange(1, 1001, dtype=float)
    rows = long(spark, {"m": (values, values)})
    stored = profile.numeric_profile(rows.filter("NOT is_current").drop("is_current"))
    row = stored.first()
    assert row.median == 500.5 and len(row.deciles) == 9 and row.n_missing == 0
    current = rows.filter("is_current").drop("is_current")
    edges = drift.edges_from_deciles(stored)
    report = drift.drift_report(current, edges, drift.uniform_mass(edges), NOW).first()
    # Uniform mass over eight bins although the outer two hold a fifth each.
    assert (report.psi_score, report.status) == (0.103972, "moderate")
    calibrated = drift.drift_report(current, drift.edges_between_deciles(stored), drift.decile_mass(stored), NOW).first()
    assert calibrated.psi_score == 0.0 and calibrated.status == "stable"


@pytest.mark.parametrize("std, inside", [(10.0, True), (0.0, False)])
def test_sigma_edges(spark, std, inside):
    g = np.random.default_rng(4)
    current = g.normal(50, 10, 500)
    stored = spark.createDataFrame([("m", "x", 50.0, std)], "model_id string, feature string, median double, std double")
    edges = drift.edges_from_sigma(stored)
    rows = long(spark, {"m": ([], current)}).drop("is_current")
    score = drift.drift_report(rows, edges, drift.uniform_mass(edges), NOW).first().psi_score
    spread = std or 1.0
    cuts = np.linspace(50 - 3 * spread, 50 + 3 * spread, 11)
    cuts[0], cuts[-1] = -np.inf, np.inf
    assert score == psi_of_counts(np.ones(10), np.histogram(current, cuts)[0])


def test_end_to_end_reports_and_tenants(spark):
    """50 shifted churn rows raise alerts; the other tenant's quiet rows raise none."""
    churn = [("churn-model:v1", json.dumps({"tenure": 70, "Contract": "Month-to-month"}), 0.95, ago(hours=1))] * 50
    quiet = [
        ("fraud-model:v1", json.dumps({"tenure": float(5 + 10 * (i % 10)), "Contract": "One year"}), 0.05 + 0.1 * (i % 10), ago(hours=1))
        for i in range(40)
    ]
    predictions = spark.createDataFrame(
        churn + quiet, "model_id string, input_features string, confidence double, created_at timestamp"
    )
    deciles = [10.0 * i for i in range(11)]
    numeric = spark.createDataFrame(
        [(m, f, d) for m in ("churn-model:v1", "fraud-model:v1")
         for f, d in (("tenure", deciles), ("_prediction", [i / 10 for i in range(11)]))],
        "model_id string, feature string, deciles array<double>",
    ).withColumn("mean", F.lit(50.0))
    counts = spark.createDataFrame(
        [("churn-model:v1", "Contract", c, n) for c, n in (("Month-to-month", 50), ("One year", 30), ("Two year", 20))]
        + [("fraud-model:v1", "Contract", "One year", 10)],
        "model_id string, feature string, category string, cnt bigint",
    )
    edges = drift.edges_from_deciles(numeric)
    expected = drift.uniform_mass(edges).unionByName(drift.category_mass(counts))
    report = drift.drift_report(payload_rows(predictions, ("tenure",), ("Contract",)), edges, expected, NOW)
    assert sorted((r.model_id, r.feature_name) for r in report.collect()) == [
        (m, f) for m in ("churn-model:v1", "fraud-model:v1") for f in ("Contract", "_prediction", "tenure")
    ]
    alerts = drift.drift_alerts(report, numeric).collect()
    assert {a.model_id for a in alerts} == {"churn-model:v1"}
    by_feature = {a.feature_name: a for a in alerts}
    assert by_feature["_prediction"].alert_type == "prediction_drift"
    tenure = json.loads(by_feature["tenure"].details)
    assert tenure["baseline_mean"] == 50.0 and tenure["current_mean"] == 70.0 and tenure["status"] == "significant"


def test_profiles_count_missing(spark):
    df = spark.createDataFrame(
        [("m", 1.0, "a"), ("m", None, None), ("m", float("nan"), "a"), ("m", 3.0, "b")], "model_id string, x double, c string"
    )
    rows = feature_rows(df, {"x": F.col("x")}, {"c": F.col("c")})
    numeric = profile.numeric_profile(rows).first()
    assert (numeric.mean, numeric.n_missing, numeric.p25) == (2.0, 2, 1.5)
    assert {(r.category, r.cnt) for r in profile.category_counts(rows).collect()} == {("a", 2), ("b", 1), ("nan", 1)}
    summary = profile.categorical_profile(rows).first()
    assert (summary.n_rows, summary.n_missing, summary.n_unique) == (4, 1, 3)
    flagged = profile.null_rates(rows, rows.filter("coalesce(number, 0) = 1 OR category = 'a' OR kind = 'rows'"))
    assert {r.feature: r.high_null_rate for r in flagged.collect()} == {"x": True, "c": True}
