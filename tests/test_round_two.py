"""Bin edges of any number, ids of any kind, empty inputs, stored baselines, whole incident rows."""

from datetime import timedelta

import pytest
from conftest import NOW, ago
from pyspark.sql import functions as F

from driftlane.functions.metrics import classification_metrics
from driftlane.operators import accuracy, canary, drift, incidents
from driftlane.operators.longform import feature_rows
from driftlane.operators.splits import id_at_rank, ordered_holdout
from driftlane.sources import files


@pytest.mark.parametrize("bins", [3, 10, 20, 57])
def test_equal_data_has_no_drift_at_any_number_of_bins(spark, bins):
    rows = spark.range(4000).select(F.lit("m:v1").alias("model_id"), (F.col("id") % 1000).alias("x"), (F.col("id") >= 2000).alias("is_current"))
    long = feature_rows(rows, {"x": F.col("x")}, {}, keep=("model_id", "is_current"))
    row = drift.drift_report_from_rows(long, NOW, bins=bins).first()
    assert row.psi_score == 0.0 and row.status == "stable"


@pytest.mark.parametrize("ids", [
    [2**60 + i for i in range(100)], [-(2**62) + i for i in range(50)] + [2**62 + i for i in range(50)],
    [i + 0.25 for i in range(100)], [f"{i:05d}-{'x' * 20}" for i in range(100)],
])
def test_ids_are_compared_exactly(spark, ids):
    kind = {int: "bigint", float: "double", str: "string"}[type(ids[0])]
    df = spark.createDataFrame([(i,) for i in ids], f"id {kind}").repartition(3)
    assert id_at_rank(df, "id", 37) == sorted(ids)[37]
    assert {r.id for r in ordered_holdout(df, "id").filter("held_out").collect()} == set(sorted(ids)[85:])


def test_nothing_to_hold_out(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert ordered_holdout(df, "id", 0.0).filter("held_out").count() == 0
    assert ordered_holdout(df.limit(0), "id").count() == 0


def test_any_id_can_be_routed(spark):
    big = spark.range(20_000).select((F.col("id") + 4_000_000_000).alias("id"))
    assert 0.08 < big.filter(canary.to_canary(F.col("id"), 10.0)).count() / 20_000 < 0.12
    text = big.select(F.concat(F.lit("r-"), "id").alias("id"))
    assert 0.08 < text.filter(canary.to_canary(F.col("id"), 10.0)).count() / 20_000 < 0.12
    assert text.filter(canary.to_canary(F.col("id"), 100.0)).count() == 20_000


def test_parts_of_hours(spark):
    got = spark.range(1).select(accuracy.since(NOW, 1.5).alias("a"), accuracy.since(NOW, 0.25).alias("b")).first()
    assert got.b - got.a == timedelta(hours=1.25)


def test_area_under_the_curve_of_scores_next_to_the_ends(spark):
    scores = [1e-12 * i for i in range(40)] + [1 - 1e-12 * i for i in range(40)] + [0.0, 0.0, 1.0, 1.0, 0.5]
    rows = [("m", s >= 0.5, s, i % 3 == 0) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "model_id string, prediction boolean, confidence double, true_label boolean")
    pos, neg = ([s for _, _, s, y in rows if y is want] for want in (True, False))
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert classification_metrics(df, ["model_id"]).first().roc_auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-9)


def test_saving_a_baseline_again_replaces_it(spark, tmp_path):
    def rows(value, *models):
        return spark.createDataFrame([(m, "x", value) for m in models], "model_id string, feature string, mean double")

    files.save_baseline(str(tmp_path), numeric=rows(1.0, "m:v1", "m:v2"))
    files.save_baseline(str(tmp_path), numeric=rows(2.0, "m:v2"))
    assert sorted((r.model_id, r.mean) for r in files.load_baseline(spark, str(tmp_path), "numeric").collect()) == [("m:v1", 1.0), ("m:v2", 2.0)]
    assert files.load_baseline(spark, str(tmp_path), "numeric", "m:v1").first().mean == 1.0


def test_text_ids_through_a_whole_pass(spark):
    def frame(table, *rows):
        names = [c.split(" ")[0] for c in files.TABLES[table].split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], files.TABLES[table])

    alerts = frame(
        "alerts", {"id": "a-1", "model_id": "m:v2", "alert_type": "accuracy_drop", "severity": "critical", "triggered_at": NOW, "processed": False},
        {"id": "a-2", "model_id": "m:v2", "alert_type": "accuracy_drop", "severity": "critical", "triggered_at": NOW, "processed": False},
    )
    deployments = frame(
        "deployments", {"id": "d-1", "model_id": "m:v1", "version": "v1", "deployed_at": ago(hours=2), "is_current": False},
        {"id": "d-2", "model_id": "m:v2", "version": "v2", "deployed_at": ago(minutes=10), "is_current": True},
    )
    opened, assigned = incidents.incident_pass(
        alerts, frame("incidents"), deployments, frame("upstream_events"), frame("drift_reports"), frame("accuracy_reports")
    )
    row = incidents.incident_rows(opened, NOW).first()
    assert (row.id, row.alert_id, row.status) == ("incident-a-1", "a-1", "auto_resolved") and row.resolved_at is not None
    assert '"rollback_to":"v1"' in row.evidence
    assert list(row.asDict()) == [c.split(" ")[0] for c in files.TABLES["incidents"].split(", ")]
    assert sorted(map(tuple, incidents.attached_alerts(assigned).collect())) == [("incident-a-1", "a-1"), ("incident-a-1", "a-2")]
    assert incidents.alerts_after_pass(alerts, assigned).filter("processed").count() == 2
