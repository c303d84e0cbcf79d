import json

import numpy as np
from conftest import NOW, ago

from driftlane.functions.metrics import classification_metrics
from driftlane.operators import accuracy


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    if not pos or not neg:
        return 0.5
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_metrics_against_brute_force(spark):
    g = np.random.default_rng(3)
    groups = {
        "spread": g.uniform(0, 1, 300), "ties": np.round(g.uniform(0, 1, 300), 1),
        "narrow": 0.5 + g.uniform(0, 1e-9, 200), "edge": g.choice([0.0, 1.0], 100),
    }
    rows, expected = [], {}
    for name, scores in groups.items():
        labels = g.uniform(0, 1, len(scores)) < 0.3 + 0.4 * (scores > np.median(scores))
        predicted = scores >= 0.5
        rows += [(name, bool(p), float(s), bool(y)) for p, s, y in zip(predicted, scores, labels)]
        tp, fp, fn = (predicted & labels).sum(), (predicted & ~labels).sum(), (~predicted & labels).sum()
        expected[name] = (len(scores), tp / (tp + fp) if tp + fp else 0, tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), brute_auc(scores, labels))
    rows += [("one_class", True, 0.9, True)] * 5 + [("none_right", False, 0.2, True), ("none_right", False, 0.3, False)]
    expected["one_class"] = (5, 1, 1, 1, 0.5)
    expected["none_right"] = (2, 0, 0, 0, 0.0)
    df = spark.createDataFrame(rows, "model_id string, prediction boolean, confidence double, true_label boolean")
    got = {r.model_id: r for r in classification_metrics(df, ["model_id"]).collect()}
    for name, want in expected.items():
        r = got[name]
        np.testing.assert_allclose([r.n_samples, r.precision, r.recall, r.f1, r.roc_auc], want, rtol=1e-12)


def frames(spark, n, hours=1):
    p = [(str(i), "m:v1", i % 2 == 0, 0.5 + i / 1000, ago(hours=hours)) for i in range(n)]
    o = [(str(i), i % 4 == 0, 300.0, ago(minutes=5)) for i in range(n)]
    return (
        spark.createDataFrame(p, "id string, model_id string, prediction boolean, confidence double, created_at timestamp"),
        spark.createDataFrame(o, "prediction_id string, true_label boolean, delay_seconds double, observed_at timestamp"),
    )


def test_report_guard_window_and_alert(spark):
    predictions, outcomes = frames(spark, 40)
    old, _ = frames(spark, 40, hours=30)
    report = accuracy.accuracy_report(predictions.unionByName(old.withColumn("id", old.id + 1000)), outcomes, NOW)
    row = report.first()
    assert (row.n_samples, row.precision, row.recall, row.f1) == (40, 0.5, 1.0, 0.6667)
    assert accuracy.accuracy_report(predictions.limit(29), outcomes, NOW).count() == 0
    base = spark.createDataFrame([("m:v1", 0.82)], "model_id string, f1 double")
    alert = accuracy.accuracy_alerts(report, base).first()
    assert json.loads(alert.details)["drop"] == 0.1533
    # 0.81 is less than 0.15 above the unrounded 2/3; no baseline means no alert.
    assert accuracy.accuracy_alerts(report, base.replace(0.82, 0.81)).count() == 0
    assert accuracy.accuracy_alerts(report, base.limit(0)).count() == 0


def test_coverage_counts_orphans(spark):
    predictions, outcomes = frames(spark, 10)
    rows = accuracy.label_coverage(predictions.filter("id < 8"), outcomes.filter("prediction_id >= 3")).collect()
    got = {r.model_id: (r.n_predictions, r.n_labelled, r.n_unlabelled, r.n_orphan_labels) for r in rows}
    assert got == {"m:v1": (8, 5, 3, 0), None: (0, 0, 0, 2)}
