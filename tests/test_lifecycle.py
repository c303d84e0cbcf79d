import json

import numpy as np
import pytest
from conftest import NOW, ago
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.operators import canary, dashboard, quality, scenario
from driftlane.operators.scenario import Perturbation

VALID = {
    "tenure": "24", "MonthlyCharges": "65.5", "TotalCharges": "1571.0",
    **{name: domain[0] for name, domain in C.CHURN.domains.items()},
}


@pytest.fixture(scope="module")
def violations(spark):
    cases = {
        "ok": {}, "missing": {"tenure": None}, "text": {"tenure": "abc"}, "negative": {"MonthlyCharges": "-1"},
        "enum": {"Contract": "Weekly"}, "two": {"gender": None, "Partner": "Maybe"},
        "implausible": {"TotalCharges": "1730.3"}, "plausible": {"TotalCharges": "1730.1"},
        "new_customer": {"tenure": "0", "TotalCharges": "999"},
        "field_first": {"TotalCharges": "9999", "gender": "x"},
    }
    names = list(VALID)
    df = spark.createDataFrame(
        [(case, *[{**VALID, **change}[n] for n in names]) for case, change in cases.items()],
        "case string, " + ", ".join(f"`{n}` string" for n in names),
    )
    return quality.validate(df, C.CHURN)


def test_validation(violations):
    got = {r.case: r.violations for r in violations.collect()}
    assert got == {
        "ok": [], "missing": ["missing:tenure"], "text": ["not_a_number:tenure"], "negative": ["negative:MonthlyCharges"],
        "enum": ["domain:Contract"], "two": ["missing:gender", "domain:Partner"],
        "implausible": ["implausible:TotalCharges"], "plausible": [], "new_customer": [], "field_first": ["domain:gender"],
    }
    valid, rejected = quality.split_valid(violations)
    assert (valid.count(), rejected.count()) == (3, 7)


def test_preprocess(spark):
    df = spark.createDataFrame(
        [("a", " ", "1.5", " YES "), ("b", "3", None, "nope")], "customerID string, TotalCharges string, tenure string, Churn string"
    )
    rows = quality.preprocess(df, C.CHURN).collect()
    assert [r.asDict() for r in rows] == [
        {"tenure": 1.5, "TotalCharges": None, "Churn": 1}, {"tenure": None, "TotalCharges": 3.0, "Churn": 0}
    ]


def test_metric_gate(spark):
    candidates = spark.createDataFrame(
        [("up", "v2", 0.81), ("same", "v2", 0.80), ("edge", "v2", 0.5), ("new", "v1", 0.01)],
        "model_name string, version string, f1 double",
    )
    base = spark.createDataFrame([("up", 0.5), ("same", 0.8), ("edge", 0.5)], "model_name string, f1 double")
    rows = {r.model_name: r for r in canary.metric_gate(candidates, base, NOW).collect()}
    assert (rows["up"].status, rows["up"].traffic_percentage, rows["up"].model_id) == ("canary", 10.0, "up:v2")
    assert rows["same"].status == "rejected" and rows["same"].traffic_percentage == 0.0
    assert "below 0.8100" in rows["same"].rejection_reason
    assert rows["edge"].status == "rejected" and rows["new"].status == "canary"


def test_canary_decisions_and_next_table(spark):
    canaries = spark.createDataFrame(
        [(m, "v2", "v1") for m in ("good", "bad", "young")], "model_name string, candidate_version string, baseline_version string"
    )
    predictions = spark.createDataFrame([(f"{m}:v2",) for m, n in (("good", 55), ("bad", 60), ("young", 49)) for _ in range(n)], "model_id string")
    alerts = spark.createDataFrame([("bad:v2",)], "model_id string")
    decisions = canary.canary_decisions(canaries, alerts, predictions)
    assert {r.model_name: r.decision for r in decisions.collect()} == {
        "good": "promoted", "bad": "canary_failed", "young": "observing"
    }
    deployments = spark.createDataFrame(
        [(f"{m}:{v}", "deployed" if v == "v1" else "canary", v == "v1", 90.0 if v == "v1" else 10.0, None)
         for m in ("good", "bad", "young") for v in ("v1", "v2")],
        "model_id string, status string, is_current boolean, traffic_percentage double, promoted_at timestamp",
    )
    after = {r.model_id: r[1:4] for r in canary.next_deployments(deployments, decisions, NOW).collect()}
    assert after == {
        "good:v1": ("deployed", False, 0.0), "good:v2": ("deployed", True, 100.0),
        "bad:v1": ("deployed", True, 90.0), "bad:v2": ("canary_failed", False, 0.0),
        "young:v1": ("deployed", True, 90.0), "young:v2": ("canary", False, 10.0),
    }
    moved = canary.rolled_back(
        spark.createDataFrame([(1, False), (2, True), (3, False)], "id bigint, is_current boolean"),
        spark.createDataFrame([(2, 1)], "serving_id bigint, target_id bigint"),
    )
    assert {r.id: r.is_current for r in moved.collect()} == {1: True, 2: False, 3: False}


def test_canary_share(spark):
    ids = spark.range(20_000)
    share = ids.filter(canary.to_canary(F.col("id"), 10.0)).count() / 20_000
    assert 0.09 < share < 0.11
    assert ids.filter(canary.to_canary(F.col("id"), 0.0)).count() == 0
    assert ids.filter(canary.to_canary(F.col("id"), 100.0)).count() == 20_000


def test_perturbations(spark):
    g = np.random.default_rng(8)
    rows = [(i, float(v), ("Month-to-month", "One year", "Two year")[i % 3], ago(hours=i % 4)) for i, v in enumerate(g.normal(30, 10, 300))]
    df = spark.createDataFrame(rows, "id bigint, tenure double, Contract string, at timestamp")
    steps = [
        Perturbation("shift", "tenure", amount=10.0), Perturbation("shift", "tenure", amount=15.0),
        Perturbation("skew", "Contract", value="Two year"), Perturbation("delay"), Perturbation("delay", amount=99.0),
    ]
    columns = scenario.perturbed({"tenure": F.col("tenure"), "Contract": F.col("Contract")}, steps, F.col("id"))
    out = df.select(
        F.avg(columns["tenure"] - F.col("tenure")).alias("rise"),
        F.avg((columns["Contract"] == "Two year").cast("int")).alias("share"),
        F.max(scenario.label_delay(F.lit(300.0), steps, F.col("at"))).alias("delay"),
    ).first()
    assert out.rise == pytest.approx(25.0) and out.share >= 0.70 and out.delay == 3000.0
    # Texts that are no number and nulls stay.
    texts = spark.createDataFrame([("x",), (None,), ("1",)], "v string").select(scenario.shifted(F.col("v"), 2.0, text=True).alias("v"))
    assert [r.v for r in texts.collect()] == ["x", None, "3.0"]
    timed = scenario.perturbed(
        {"tenure": F.col("tenure")}, [Perturbation("corrupt", "tenure", started_at=ago(hours=2), ended_at=ago(hours=1))],
        F.col("id"), F.col("at"),
    )
    lost = df.filter(timed["tenure"].isNull()).select("at").distinct().collect()
    assert [r["at"].replace(tzinfo=None) for r in lost] == [ago(hours=2).replace(tzinfo=None)]


def test_significance_statistics(spark):
    g = np.random.default_rng(9)
    a, b = g.normal(30, 10, 200), g.normal(50, 12, 150)
    df = spark.createDataFrame([("m", False, float(v)) for v in a] + [("m", True, float(v)) for v in b], "m string, is_current boolean, v double")
    row = scenario.welch_statistic(df, ["m"], "v").first()
    va, vb = a.var(ddof=1) / 200, b.var(ddof=1) / 150
    assert row.t_statistic == pytest.approx((b.mean() - a.mean()) / np.sqrt(va + vb))
    assert row.degrees == pytest.approx((va + vb) ** 2 / (va**2 / 199 + vb**2 / 149))
    counts = [("m", False, c) for c, n in (("x", 50), ("y", 50)) for _ in range(n)] + [("m", True, c) for c, n in (("x", 30), ("y", 10)) for _ in range(n)]
    chi = scenario.chi_square_statistic(spark.createDataFrame(counts, "m string, is_current boolean, c string"), ["m"], "c").first()
    assert (chi.chi_square, chi.degrees) == (pytest.approx(10.0), 1)


def test_kpi_cards_default_without_rows(spark):
    deployments = spark.createDataFrame(
        [("a:v1", "v1", "deployed", 0.0, ago(days=2), 1), ("a:v2", "v2", "canary", 10.0, ago(days=3), 2)],
        "model_id string, version string, status string, traffic_percentage double, deployed_at timestamp, id bigint",
    )
    ids = spark.createDataFrame([("b:v1",)] * 3, "model_id string")
    none = spark.createDataFrame([], "model_id string, status string")
    cards = {r.model_name: r for r in dashboard.kpi_cards(deployments, ids, ids.limit(0), none).collect()}
    assert cards["a"][1:] == ("v1", "deployed", 100.0, 0, 0, 0)
    assert cards["b"][1:] == ("N/A", "Unknown", 0.0, 3, 0, 0)


def test_forward_fill_crosses_days(spark):
    rows = [("a", 1, ago(days=5), 1.0), ("a", 2, ago(days=3), None), ("a", 3, ago(days=3, hours=-1), None), ("a", 4, ago(days=1), 2.0),
            ("a", 5, ago(hours=1), None), ("b", 6, ago(days=9), None), ("b", 7, ago(hours=3), None)]
    df = spark.createDataFrame(rows, "k string, id int, at timestamp, v double")
    out = {r.id: r.v for r in dashboard.forward_fill(df, ["k"], "at", ["v"], tie=["id"]).collect()}
    assert out == {1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: None, 7: None}


def test_file_round_trips(spark, tmp_path):
    from driftlane.sources import files

    held_out = spark.createDataFrame([("a", " "), ("b", "2.5")], "customerID string, TotalCharges string")
    files.write_holdout(held_out, str(tmp_path / "sim"))
    back = files.read_holdout(spark, str(tmp_path / "sim"), "customerID string, TotalCharges string", ["TotalCharges"])
    assert {r.customerID: r.TotalCharges for r in back.collect()} == {"a": 0.0, "b": 2.5}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_csv(spark, str(tmp_path / "nowhere"), "a string").count()

    alerts = spark.createDataFrame(
        [("1", "m:v1", "feature_drift", "warning", ago(days=1), False, "{}"), ("2", "n:v1", "feature_drift", "warning", NOW, False, "{}")],
        files.TABLES["alerts"],
    )
    files.append_table(alerts, str(tmp_path), "alerts")
    files.append_table(alerts.filter("id = '2'").withColumn("id", F.lit("3")), str(tmp_path), "alerts")
    stored = files.read_table(spark, str(tmp_path), "alerts")
    pruned = stored.filter((F.col("model_name") == "n") & (F.col("dt") == F.lit(NOW.date())))
    assert sorted(r.id for r in pruned.collect()) == ["2", "3"] and stored.count() == 3
    assert "PartitionFilters: [isnotnull(model_name" in pruned._jdf.queryExecution().toString()

    document = {
        "model_name": "churn-model", "version": "v3", "eval_metrics": {"precision": 0.5, "recall": 0.6, "f1": 0.55, "roc_auc": 0.7},
        "training_data_snapshot": {
            "numeric": {"tenure": {"mean": 1.0, "std": 2.0, "median": 1.0, "p25": 0.5, "p75": 2.0, "deciles": [1.0, 2.0], "n_missing": 0}},
            "categorical": {"Contract": {"value_counts": {"One year": 3, "Two year": 4}, "n_missing": 0, "n_unique": 2}},
            "prediction": {"mean_confidence": 0.4, "deciles": [0.1, 0.2], "positive_class_ratio": 0.25},
        },
    }
    (tmp_path / "metadata.json").write_text(json.dumps(document, indent=2))
    tables = files.read_snapshot(spark, str(tmp_path / "metadata.json"))
    assert tables["numeric"].first().deciles == [1.0, 2.0]
    assert {(r.model_id, r.category, r.cnt) for r in tables["categorical"].collect()} == {
        ("churn-model:v3", "One year", 3), ("churn-model:v3", "Two year", 4)
    }
    assert tables["metrics"].first().f1 == 0.55
    files.save_baseline(str(tmp_path), numeric=tables["numeric"])
    assert files.load_baseline(spark, str(tmp_path), "numeric").count() == 1
    assert files.prediction_as_feature(tables["prediction"]).first().feature == "_prediction"
    (tmp_path / "bare.json").write_text(json.dumps({"model_name": "x", "version": "v1"}))
    assert all(t.count() == 0 for t in files.read_snapshot(spark, str(tmp_path / "bare.json")).values())
