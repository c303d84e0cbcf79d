import numpy as np
import pytest
from conftest import NOW

from driftlane.config import Tenant
from driftlane.operators import modeling

TENANT = Tenant(name="toy", id_column="id", target="label", numeric=("x", "y"), categorical=("c",))


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(12)
    data = []
    for i in range(240):
        label = int(i % 3 == 0)
        x = None if i % 17 == 0 else float(g.normal(2.0 * label, 1.0))
        data.append((f"id{i:04d}", x, float(g.normal(0, 1)), None if i % 19 == 0 else str(g.choice(["p", "q"])), label))
    return spark.createDataFrame(data, "id string, x double, y double, c string, label int")


def test_preprocessing_and_coefficients(spark, rows):
    model = modeling.fit(rows, TENANT)
    data = rows.toPandas()
    filled = data[["x", "y"]].fillna(data[["x", "y"]].median())
    z = (filled - filled.mean()) / filled.std(ddof=0)
    codes = data["c"].fillna("missing").map({"missing": 0, "p": 1, "q": 2})
    X = np.column_stack([z, codes, np.ones(len(data))])
    y = data["label"].to_numpy()
    weight = len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    beta = np.zeros(4)
    penalty = np.diag([1.0, 1, 1, 0])  # L2 with C = 1, the intercept is free
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        step = np.linalg.solve((X.T * (weight * p * (1 - p))) @ X + penalty, X.T @ (weight * (p - y)) + penalty @ beta)
        beta -= step
    fitted = model.stages[-1]
    np.testing.assert_allclose([*fitted.coefficients, fitted.intercept], beta, atol=1e-4)
    # Categories never seen in training are coded -1.
    unseen = spark.createDataFrame([("n", 0.0, 0.0, "new", 0)], rows.schema)
    assert model.transform(unseen).first().features[2] == -1.0
    scored = modeling.score(model, rows).first()
    assert 0.5 <= scored.confidence <= 1.0 and isinstance(scored.prediction, bool)


def test_train_and_retrain(spark, rows):
    trained = modeling.train_model(rows, TENANT)
    metrics = trained.metrics.first()
    assert metrics.model_id == "toy:v1" and metrics.f1 > 0.6
    assert {r.feature for r in trained.numeric.collect()} == {"x", "y"}
    assert {r.category for r in trained.categorical.collect()} == {"p", "q", "nan"}
    assert len(trained.prediction.first().deciles) == 9

    approved, candidate = modeling.retrain(rows, TENANT, None, "v2", NOW)
    row = approved.first()
    assert (row.status, row.model_id, row.traffic_percentage) == ("canary", "toy:v2", 10.0) and candidate is not None
    rejected, _ = modeling.retrain(rows, TENANT, candidate, "v3", NOW)
    row = rejected.first()
    assert row.status == "rejected" and "is below" in row.rejection_reason
    skipped, nothing = modeling.retrain(rows.limit(99), TENANT, None, "v2", NOW)
    assert skipped.first().status == "skipped" and nothing is None
