"""Stored versions, committed batches, raw training rows, numbered categories and written-out bins."""

import numpy as np
import pytest
from conftest import NOW, ago
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.functions import psi
from driftlane.operators import modeling, quality, scenario, splits
from driftlane.operators.scenario import Perturbation
from driftlane.sources import files


def alert_rows(spark, *ids, at=NOW):
    return spark.createDataFrame([(i, "m:v1", "feature_drift", "warning", at, False, "{}") for i in ids], files.TABLES["alerts"])


def test_a_batch_is_appended_once(spark, tmp_path):
    root = str(tmp_path)
    files.commit_batch(alert_rows(spark, "1", "2"), root, "alerts", "b1")
    files.commit_batch(alert_rows(spark, "1", "2"), root, "alerts", "b1")
    files.commit_batch(alert_rows(spark, "3", at=ago(days=2)), root, "alerts", "b2")
    assert sorted(r.id for r in files.read_committed(spark, root, "alerts").collect()) == ["1", "2", "3"]
    # Tried again with other days: nothing of the first try stays.
    files.commit_batch(alert_rows(spark, "4"), root, "alerts", "b2")
    # Written, but the commit is missing.
    alert_rows(spark, "9").withColumns({"model_name": F.lit("m"), "dt": F.to_date("triggered_at")}).write.partitionBy(
        "model_name", "dt").parquet(f"{root}/alerts/batch=b3")
    stored = files.read_committed(spark, root, "alerts")
    assert sorted(r.id for r in stored.collect()) == ["1", "2", "4"]
    assert "PartitionFilters: [isnotnull(dt" in stored.where(F.col("dt") == F.lit(NOW.date()))._jdf.queryExecution().toString()


def test_the_newest_version_by_number(spark, tmp_path):
    def metrics(model_id, f1):
        return spark.createDataFrame([(model_id, 10, 0.5, 0.5, f1, 0.5)], f"model_id string, {files.BASELINES['metrics']}")

    for model_id, f1 in (("a:v9", 0.1), ("a:v10", 0.2), ("b:v2", 0.3), ("b:v1", 0.4), ("c:latest", 0.5)):
        files.save_baseline(str(tmp_path), metrics=metrics(model_id, f1))
    newest = {r.model_id: r.f1 for r in files.load_newest(spark, str(tmp_path), "metrics").collect()}
    assert newest == {"a:v10": 0.2, "b:v2": 0.3, "c:latest": 0.5}
    assert files.load_baseline(spark, str(tmp_path), "metrics", "a:v9").first().f1 == 0.1


def test_raw_fraud_rows_are_trained_and_saved(spark, tmp_path):
    g = np.random.default_rng(4)
    rows = []
    for i in range(300):
        fraud = int(i % 4 == 0)
        amount = "n/a" if i % 50 == 0 else f"{g.normal(100 + 80 * fraud, 20):.2f}"
        rows.append((f"t{i:05d}", amount, "3.5", str(i % 90), str(i % 5), "retail" if i % 3 else None, "web_desktop", "0", "1", " YES " if fraud else "no"))
    names = ["transaction_id", *C.FRAUD.numeric, *C.FRAUD.categorical, "is_fraud"]
    raw = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    cleaned = quality.training_rows(raw, C.FRAUD)
    assert cleaned.columns == ["transaction_id", *C.FRAUD.features, "label"]
    assert quality.preprocess(raw, C.FRAUD).columns == [*C.FRAUD.features, "is_fraud"]
    raw.write.option("header", True).csv(str(tmp_path / "raw"))
    trained = modeling.train_from_csv(spark, str(tmp_path / "raw"), C.FRAUD, "v3", str(tmp_path / "store"))
    stored = files.load_newest(spark, str(tmp_path / "store"), "metrics").first()
    assert stored.model_id == "fraud-model:v3" and stored.f1 == trained.metrics.first().f1 > 0.7
    profile = {r.feature: r for r in files.load_baseline(spark, str(tmp_path / "store"), "numeric", "fraud-model:v3").collect()}
    assert set(profile) == set(C.FRAUD.numeric) and profile["transaction_amount"].n_missing > 0
    assert files.load_newest(spark, str(tmp_path / "store"), "prediction").first().deciles is not None


def test_the_gradient_vanishes_at_the_fit_only(spark):
    g = np.random.default_rng(2)
    tenant = C.Tenant(name="toy", id_column="id", target="label", numeric=("x", "y"), categorical=("c",))
    rows = spark.createDataFrame(
        [(i, float(g.normal(i % 2, 1)), float(g.normal()), str(i % 3), i % 2) for i in range(200)], "id int, x double, y double, c string, label int"
    )
    model = modeling.fit(rows, tenant)
    assert all(abs(r.gradient) < 1e-4 for r in modeling.gradient(model, rows).collect())
    other = rows.withColumn("label", F.when(F.col("id") < 100, 0).otherwise(1))
    assert any(abs(r.gradient) > 1e-2 for r in modeling.gradient(model, other).collect())


def test_many_categories_are_numbered_by_many_tasks(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("big"), (F.col("id") % 3).alias("small"))
    codes = modeling.category_codes(rows, ("big", "small"))
    spread = codes.groupBy("feature").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count("*").alias("n"), F.countDistinct("code").alias("d"))
    assert {r.feature: (r.low, r.high, r.n, r.d) for r in spread.collect()} == {"big": (0, 199_999, 200_000, 200_000), "small": (0, 2, 3, 3)}
    assert codes.where("feature = 'big' AND category = 'c0123456'").first().code == 123_456


@pytest.mark.parametrize("kind", ["bigint", "string", "decimal(12,0)", "double"])
def test_id_at_rank_of_every_kind(spark, kind):
    g = np.random.default_rng(7)
    numbers = sorted({int(n) for n in g.integers(-(2**50), 2**50, 300)} if kind == "bigint" else {int(n) for n in g.integers(10, 10**9, 300)})
    ids = spark.createDataFrame([(n,) for n in g.permutation(numbers).tolist()], "id bigint")
    ids = ids.select((F.concat(F.lit("customer-"), F.lpad(F.col("id").cast("string"), 12, "0")) if kind == "string" else F.col("id").cast(kind)).alias("id"))
    for rank in (0, 1, 150, len(numbers) - 1):
        want = f"customer-{numbers[rank]:012d}" if kind == "string" else numbers[rank]
        assert splits.id_at_rank(ids, "id", rank) == want


@pytest.mark.parametrize("count", [0, 1, 9, 64, 65, 300])
def test_bins_of_any_number_of_edges(spark, count):
    edges = [float(i) for i in range(count)]
    values = [-1.0, 0.0, 0.5, count - 1.0, count + 5.0]
    df = spark.createDataFrame([(v, edges) for v in values], "v double, edges array<double>")
    got = [r[0] for r in df.select(psi.bin_number(F.col("v"), F.col("edges"), count)).collect()]
    assert got == [sum(e <= v for e in edges) for v in values]


def test_response_curve_equals_separate_reports(spark):
    from driftlane.operators import drift, profile
    from driftlane.operators.longform import feature_rows

    g = np.random.default_rng(3)
    rows = [("m:v1", i, None if i % 31 == 0 else float(g.normal(50, 10)), str(g.choice(["a", "b"]))) for i in range(400)]
    df = spark.createDataFrame(rows, "model_id string, id bigint, x double, c string")
    base = {"x": F.col("x"), "c": F.col("c")}

    def long(columns):
        return feature_rows(df, {"x": columns["x"]}, {"c": columns["c"]})

    stored = profile.numeric_profile(long(base))
    edges = drift.edges_from_deciles(stored)
    expected = drift.uniform_mass(edges).unionByName(drift.category_mass(profile.category_counts(long(base))))
    scenarios = {
        "none": (), "both": (Perturbation("shift", "x", amount=7.0), Perturbation("skew", "c", value="b")),
        "gone": (Perturbation("corrupt", "x"),), "new": (Perturbation("skew", "c", value="z", probability=0.4),),
    }
    curve = scenario.response_curve(df, scenarios, ("x",), ("c",), "id", edges, expected, NOW)
    got = {(r.scenario, r.feature_name): (r.psi_score, r.sample_size) for r in curve.collect()}
    want = {}
    for name, steps in scenarios.items():
        for r in drift.drift_report(long(scenario.perturbed(base, steps, F.col("id"))), edges, expected, NOW).collect():
            want[name, r.feature_name] = (r.psi_score, r.sample_size)
    assert got == want and len(got) == 8


def test_all_tenants_in_one_fit_equal_single_fits(spark):
    from driftlane.operators import tenants

    g = np.random.default_rng(6)
    a = C.Tenant(name="a", id_column="id", target="label", numeric=("x", "y"), categorical=("c",))
    b = C.Tenant(name="b", id_column="id", target="label", numeric=("x",), categorical=())
    rows = spark.createDataFrame(
        [(i, None if i % 13 == 0 else float(g.normal(i % 2, 2)), float(g.normal()), str(i % 3) if i % 7 else None, int(i % 5 == 0 or g.random() < 0.2)) for i in range(400)],
        "id int, x double, y double, c string, label int",
    )
    prepared = tenants.prepared_rows(rows, a).unionByName(tenants.prepared_rows(rows.where("id < 90"), b))
    fitted = {r.model_name: r.coefficients for r in tenants.fit_tenants(prepared).collect()}
    model = modeling.fit(rows, a)
    single = model.stages[-1]
    np.testing.assert_allclose(fitted["a"], [*single.coefficients, single.intercept], atol=2e-4)
    assert len(fitted["b"]) == 2
    scored = {r.id: r for r in tenants.score_tenants(prepared.where("model_name = 'a'"), spark.createDataFrame(
        [("a", fitted["a"])], "model_name string, coefficients array<double>")).collect()}
    for r in modeling.score(model, rows).collect():
        assert scored[str(r.id)].probability_1 == pytest.approx(r.probability_1, abs=1e-3)
    # Categories that were not there when codes were made.
    new = rows.limit(3).withColumn("c", F.lit("never seen"))
    assert all(r.features[2] == -1.0 for r in tenants.prepared_rows(new, a, fitted_on=rows).collect())
