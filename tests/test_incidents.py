from datetime import timedelta

import numpy as np
import pytest
from conftest import NOW, ago
from pyspark.sql import functions as F

from driftlane.functions.intervals import ALL_LEVELS, OPEN_END, interval_blocks, point_blocks
from driftlane.operators import incidents as I

ALERT = "id bigint, model_id string, alert_type string, severity string, triggered_at timestamp, processed boolean"
DEPLOY = "id bigint, model_id string, version string, deployed_at timestamp, is_current boolean"
UPSTREAM = "id bigint, event_type string, feature string, started_at timestamp, ended_at timestamp"
DRIFT = "id bigint, model_id string, feature_name string, status string, checked_at timestamp"
ACCURACY = (
    "id bigint, model_id string, f1 double, precision double, recall double, roc_auc double, n_samples bigint, "
    "created_at timestamp"
)
OLD = "id bigint, model_id string, created_at timestamp"


def test_blocks_find_every_containing_interval_once(spark):
    g = np.random.default_rng(5)
    starts = g.integers(0, 5000, 150)
    intervals = [(i, int(s), int(s + d)) for i, (s, d) in enumerate(zip(starts, g.integers(0, 3000, 150)))]
    intervals += [(900, 17, 17), (901, 0, OPEN_END), (902, 4095, 4096)]
    points = [(i, int(p)) for i, p in enumerate([*g.integers(0, 9000, 200), 17, 0, 4095, 4096, 4097])]
    left = interval_blocks(
        spark.createDataFrame(intervals, "i bigint, a bigint, b bigint"), F.col("a"), F.col("b"), ALL_LEVELS, ["i"]
    )
    right = point_blocks(spark.createDataFrame(points, "p bigint, at bigint"), F.col("at"), ALL_LEVELS, ["p"])
    got = sorted((r.p, r.i) for r in right.join(left, ["level", "block"]).collect())
    assert got == sorted((p, i) for p, at in points for i, a, b in intervals if a <= at <= b)


def case(spark, alert_type="accuracy_drop", deploys=(), upstream=(), drift=(), accuracy=(), existing=()):
    alert = [(1, "churn-model:v2", alert_type, "critical", NOW, False)]
    frames = [
        spark.createDataFrame(list(rows), schema)
        for rows, schema in ((alert, ALERT), (existing, OLD), (deploys, DEPLOY), (upstream, UPSTREAM), (drift, DRIFT), (accuracy, ACCURACY))
    ]
    opened, _ = I.incident_pass(*frames)
    return opened.first()


M = "churn-model:v2"
V1 = (10, "churn-model:v1", "v1", ago(hours=2), False)
V2 = (11, M, "v2", ago(minutes=10), True)
ACC = (30, M, 0.6, 0.6, 0.6, 0.7, 100, ago(hours=1))


@pytest.mark.parametrize(
    "setup, expected",
    [
        (dict(deploys=[V1, V2]), ("bad_deploy", 0.90, "rollback", "auto_resolved", "v1")),
        (dict(deploys=[V2]), ("bad_deploy", 0.20, "escalate", "escalated", None)),
        (
            dict(alert_type="feature_drift", upstream=[(20, "corrupt_feature", "tenure", ago(minutes=15), None)]),
            ("upstream_data_issue", 0.85, "fix_upstream_data", "escalated", None),
        ),
        (
            dict(alert_type="feature_drift", drift=[(21, M, "tenure", "significant", ago(hours=1))]),
            ("single_feature_drift", 0.65, "monitor", "escalated", None),
        ),
        (
            dict(alert_type="feature_drift", accuracy=[ACC], drift=[
                (21, M, "tenure", "significant", ago(hours=1)), (22, M, "Contract", "moderate", ago(hours=2))]),
            ("broad_concept_drift", 0.70, "retrain", "escalated", None),
        ),
        (dict(alert_type="feature_drift"), ("unclear_cause", 0.20, "escalate", "escalated", None)),
        # Just outside every window.
        (
            dict(
                alert_type="feature_drift", deploys=[(11, M, "v2", ago(minutes=31), True)],
                upstream=[(20, "x", "y", ago(hours=3), ago(minutes=31))],
                drift=[(21, M, "tenure", "significant", ago(hours=25))],
            ),
            ("unclear_cause", 0.20, "escalate", "escalated", None),
        ),
    ],
)
def test_rules(spark, setup, expected):
    row = case(spark, **setup)
    assert (row.rule_name, row.confidence, row.recommended_action, row.status, row.rollback_to) == expected
    assert len(row.reasoning_log) == (9 if expected[3] == "auto_resolved" else 8)
    assert row.reasoning_log[-1].startswith("Step 9: resolved by going back to v1" if expected[3] == "auto_resolved" else "Step 8")
    if expected[:2] == ("bad_deploy", 0.20):
        assert "Rollback impossible" in row.hypothesis


def sequential_pass(alerts, incidents, now):
    """The pass as a loop over alerts in time order."""
    incidents, out = list(incidents), {}
    for aid, model, at in sorted(alerts, key=lambda a: (a[2], a[0])):
        same = [i for i in incidents if i[1] == model and i[2] >= at - timedelta(minutes=15)]
        if same:
            out[aid] = max(same, key=lambda i: (i[2], i[0]))[0]
        else:
            incidents.append((1000 + aid, model, now))
            out[aid] = "opens"
    return out


def test_assignment_equals_the_loop(spark):
    g = np.random.default_rng(6)
    alerts = [(i, f"m{g.integers(0, 12)}", ago(minutes=float(g.integers(0, 600)))) for i in range(300)]
    existing = [(500 + i, f"m{g.integers(0, 8)}", ago(minutes=float(g.integers(0, 900)))) for i in range(12)]
    df = spark.createDataFrame([(i, m, "feature_drift", "warning", t, False) for i, m, t in alerts], ALERT)
    got = I.assign_alerts(df, spark.createDataFrame(existing, OLD)).collect()
    want = sequential_pass(alerts, existing, NOW + timedelta(hours=1))
    assert len(got) == len(alerts)
    for r in got:
        expected = want[r.id]
        if expected == "opens":
            assert r.decision == "opens"
        elif expected >= 1000:
            assert (r.decision, r.opened_by) == ("attached", expected - 1000)
        else:
            assert (r.decision, r.incident_id) == ("existing", expected)


def test_shortening(spark):
    names = [f"f{i:02d}" for i in range(20)]
    df = spark.createDataFrame(
        [(1, names, 20, [f"Step {i}" for i in range(20)])],
        "id int, drifting_features array<string>, drifting_count int, reasoning_log array<string>",
    )
    row = I.shorten_evidence(df).first()
    assert row.drifting_features == names[:10] and row.note == "10 more features left out"
    assert row.reasoning_log == [f"Step {i}" for i in range(15, 20)]
    items = spark.createDataFrame(
        [(1, "upstream", i, ago(minutes=i), "x" * 500, None) for i in range(10)],
        "alert_id int, kind string, item_id int, item_at timestamp, label string, feature string",
    )
    short = I.shorten_items(items).collect()
    assert sorted(r.item_id for r in short) == [0, 1, 2, 3, 4]
    assert all(r.label == "x" * 200 + "… (truncated)" for r in short)


def brute_evidence(alerts, deploys, upstream, drift, accuracy):
    """Every pair looked at."""
    out = {}
    for aid, model, _, _, at, _ in alerts:
        near = [d for d in deploys if d[1] == model and at - timedelta(minutes=30) <= d[3] <= at + timedelta(minutes=5)]
        active = [u for u in upstream if u[3] <= at + timedelta(minutes=5) and (u[4] is None or u[4] >= at - timedelta(minutes=30))]
        reports = [r for r in drift if r[1] == model and at - timedelta(hours=24) <= r[4] <= at]
        known = [a for a in accuracy if a[1] == model and at - timedelta(hours=24) <= a[7] <= at]
        out[aid] = (
            len(near), max(((d[3], d[0]) for d in near), default=(None, None))[1],
            len(active), max(((u[3], u[0]) for u in active), default=(None, None))[1],
            len(reports), sorted({r[2] for r in reports if r[3] != "stable" and r[2] != "_all_features"}),
            max(((a[7], a[0]) for a in known), default=(None, None))[1],
        )
    return out


def test_evidence_equals_all_pairs(spark):
    """Times on the minute, so that many fall on the ends of windows and on whole hours."""
    g = np.random.default_rng(8)

    def at(hours=60):
        return NOW - timedelta(minutes=int(g.integers(0, hours * 60)) // 30 * 30 + int(g.choice([0, 0, 5, 25, 31])))

    def model():
        return None if g.random() < 0.05 else "hot:v1" if g.random() < 0.6 else f"m{g.integers(0, 4)}:v1"

    alerts = [(i, model(), "feature_drift", "warning", at(), False) for i in range(150)]
    deploys = [(i, model(), "v", at(), False) for i in range(80)]
    upstream = []
    for i in range(60):
        start = at()
        end = None if i % 9 == 0 else start + timedelta(minutes=int(g.integers(-60, 900)))
        upstream.append((i, "x", "f", start, end))
    drift = [(i, model(), str(g.choice(["a", "b", "_all_features", "_prediction"])), str(g.choice(["stable", "moderate"])), at(90)) for i in range(300)]
    accuracy = [(i, model(), 0.5, 0.5, 0.5, 0.5, 10, at(90)) for i in range(60)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (alerts, ALERT), (deploys, DEPLOY), (upstream, UPSTREAM), (drift, DRIFT), (accuracy, ACCURACY))]
    got = {
        r.id: (
            r.n_deployments, r.deployment and r.deployment.id, r.n_upstream, r.upstream and r.upstream.id, r.n_reports,
            r.drifting_features, r.accuracy and r.accuracy.id,
        )
        for r in I.gather_evidence(*frames).collect()
    }
    want = brute_evidence(alerts, deploys, upstream, drift, accuracy)
    for aid, alert_model, *_ in alerts:
        if alert_model is None:  # without a model only what concerns every model
            want[aid] = (0, None, *want[aid][2:4], 0, [], None)
    # An event that ends before it starts is under way for no alert, unless both windows reach it.
    assert got == want


def test_evidence_without_alerts_or_context(spark):
    frames = [spark.createDataFrame([], s) for s in (ALERT, DEPLOY, UPSTREAM, DRIFT, ACCURACY)]
    assert I.gather_evidence(*frames).collect() == []


def test_latest_before_one_hot_group(spark):
    """Half of all rows in one group lie in several lots; each asks for what another lot brings."""
    from driftlane.functions.asof import latest_before

    g = np.random.default_rng(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        events = [(i, "hot" if i % 2 else f"g{i % 7}", int(g.integers(0, 4000))) for i in range(600)]
        probes = [(i, "hot" if i % 2 else f"g{i % 9}", int(g.integers(-50, 4000))) for i in range(600)]
        found = latest_before(
            spark.createDataFrame(probes, "id bigint, k string, at bigint"), spark.createDataFrame(events, "id bigint, k string, t bigint"),
            ["k"], "at", "t", "id", F.col("id"), "newest",
        )
        got = {r.id: r.newest for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {i: max(((t, e) for e, k2, t in events if k2 == k and t <= at), default=(None, None))[1] for i, k, at in probes}
    assert got == want
