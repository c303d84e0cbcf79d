from datetime import timedelta

import numpy as np
from conftest import NOW, ago
from pyspark.sql import functions as F

from driftlane.operators import drift, incidents
from driftlane.operators.longform import feature_rows
from driftlane.sources import files
from driftlane.streaming import corrections, streams


def source(spark, folder, schema, batches):
    """A file stream that delivers one batch of rows at a time, in order."""
    for i, rows in enumerate(batches):
        path = folder / f"part{i:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        (file,) = path.glob("*.parquet")
        target = folder / "in" / f"{i:03d}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(file.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def drain(stream, folder, name="out"):
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").option("path", str(folder / name)).outputMode("append")
    query = streams.run_available(writer, str(folder / f"{name}-offsets"))
    return spark.read.schema(stream.schema).parquet(str(folder / name)), query


def brute_dedup(alerts, minutes=15):
    anchors, out = {}, {}
    for aid, model, at in sorted(alerts, key=lambda a: (a[2], a[0])):
        anchor = anchors.get(model)
        opens = anchor is None or anchor < at - timedelta(minutes=minutes)
        if opens:
            anchors[model] = at
        out[aid] = (opens, anchors[model].replace(tzinfo=None))
    return out


def test_dedup_over_many_batches_equals_one_scan(spark, tmp_path):
    g = np.random.default_rng(10)
    alerts = sorted(
        [(i, f"m{g.integers(0, 3)}", ago(seconds=float(g.integers(0, 40_000)))) for i in range(400)], key=lambda a: a[2]
    )
    schema = "id bigint, model_id string, triggered_at timestamp"
    stream = source(spark, tmp_path, schema, [alerts[i:i + 57] for i in range(0, 400, 57)])
    out, _ = drain(streams.deduplicate_alerts(stream), tmp_path)
    assert {r.id: (r.opens, r.opened_at) for r in out.collect()} == brute_dedup(alerts)


def test_alert_late_by_a_batch_joins(spark, tmp_path):
    schema = "id bigint, model_id string, triggered_at timestamp"
    batches = [[(1, "m", ago(minutes=20))], [(2, "m", ago(minutes=25)), (3, "m", ago(minutes=1))]]
    out, _ = drain(streams.deduplicate_alerts(source(spark, tmp_path, schema, batches)), tmp_path)
    assert {r.id: r.opens for r in out.collect()} == {1: True, 2: False, 3: True}


def test_delayed_labels_and_never_labelled(spark, tmp_path):
    p_schema = "id string, model_id string, prediction boolean, created_at timestamp"
    o_schema = "prediction_id string, true_label boolean, observed_at timestamp"
    p = [("a", "m", True, ago(hours=9)), ("b", "m", True, ago(hours=9)), ("c", "m", False, ago(hours=9))]
    later = [("z", "m", True, NOW)]
    o = [("a", True, ago(hours=9, minutes=-5)), ("b", False, ago(hours=7)), ("orphan", True, ago(hours=8))]
    (tmp_path / "p").mkdir(), (tmp_path / "o").mkdir()
    joined = streams.delayed_labels(
        source(spark, tmp_path / "p", p_schema, [p, later, later]),
        source(spark, tmp_path / "o", o_schema, [o, [("y", True, NOW)], [("x", True, NOW)]]),
        keep_unlabelled=True,
    )
    out, _ = drain(joined, tmp_path)
    got = {r.id: r.true_label for r in out.collect()}
    # "b" was labelled after the longest delay, so it counts as never labelled.
    assert got == {"a": True, "b": None, "c": None}


def test_hourly_volume_drops_late_rows_that_a_recount_includes(spark, tmp_path):
    schema = "model_id string, created_at timestamp"
    first = [("m:v1", ago(hours=5, minutes=-i)) for i in range(10)]
    late = [("m:v1", ago(hours=5, minutes=-30))]
    # A batch drops what was late by the watermark of the batch before it.
    batches = [first, [("m:v1", ago(hours=1))], [("m:v1", ago(minutes=50))], late + [("m:v1", NOW)], [("m:v1", NOW + timedelta(hours=3))]]
    out, query = drain(streams.hourly_volume(source(spark, tmp_path, schema, batches)), tmp_path)
    counts = {r.hour: r.n_predictions for r in out.collect()}
    assert counts[ago(hours=5).replace(tzinfo=None)] == 10
    assert streams.dropped_late_rows(query) == 1
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    recount = batch.filter(F.date_trunc("hour", "created_at") == F.lit(ago(hours=5))).count()
    assert recount == 11


def test_window_drift_equals_batch_drift_of_the_window(spark, tmp_path):
    g = np.random.default_rng(11)
    schema = "model_id string, created_at timestamp, x double, c string"
    days = [
        [("m:v1", ago(days=10 - d, hours=float(h)), float(v), str(c)) for h, v, c in zip(
            g.uniform(0, 10, 80), g.normal(50 + 10 * d, 10, 80), g.choice(["a", "b"], 80))]
        for d in range(3)
    ]
    flush = [[("m:v1", NOW, 0.0, "a")]]
    stream = source(spark, tmp_path, schema, days + flush)

    def long(df, keep):
        return feature_rows(df, {"x": F.col("x")}, {"c": F.col("c")}, keep)

    edges = spark.createDataFrame([("m:v1", "x", [40.0, 50.0, 60.0])], "model_id string, feature string, edges array<double>")
    counts = spark.createDataFrame(
        [("m:v1", "c", "a", 70), ("m:v1", "c", "z", 30)], "model_id string, feature string, category string, cnt bigint"
    )
    expected = drift.uniform_mass(edges).unionByName(drift.category_mass(counts))
    bins, _ = drain(streams.window_bins(long(stream, ("model_id", "created_at")), edges, "1 day", "1 hour"), tmp_path)
    got = {(r.window_start, r.feature_name): (r.psi_score, r.sample_size) for r in streams.window_drift(bins, expected).collect()}
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    want = {}
    for start in {k[0] for k in got}:
        day = batch.filter((F.to_date("created_at") == F.lit(start.date())))
        for r in drift.drift_report(long(day, ("model_id",)), edges, expected, NOW, minimum=0).collect():
            want[(start, r.feature_name)] = (r.psi_score, r.sample_size)
    assert got == want and len(got) >= 6


def test_continuous_incidents_do_not_repeat(spark, tmp_path):
    schema = "id bigint, model_id string, alert_type string, severity string, triggered_at timestamp"
    alerts = [
        [(1, "m:v1", "feature_drift", "warning", ago(minutes=9)), (2, "m:v1", "feature_drift", "warning", ago(minutes=8))],
        [(3, "m:v1", "feature_drift", "warning", ago(minutes=7)), (4, "n:v1", "accuracy_drop", "critical", ago(minutes=7))],
    ]
    stream = source(spark, tmp_path, schema, alerts)

    def context(session):
        empty = {
            "deployments": "id bigint, model_id string, version string, deployed_at timestamp, is_current boolean",
            "upstream": "id bigint, event_type string, feature string, started_at timestamp, ended_at timestamp",
            "drift": "id bigint, model_id string, feature_name string, status string, checked_at timestamp",
            "accuracy": "id bigint, model_id string, f1 double, precision double, recall double, roc_auc double, "
                        "n_samples bigint, created_at timestamp",
        }
        return {name: session.createDataFrame([], columns) for name, columns in empty.items()}

    streams.run_available(streams.continuous_incidents(stream, context, str(tmp_path / "sink")), str(tmp_path / "offsets"))
    opened = spark.read.parquet(str(tmp_path / "sink" / "incidents")).collect()
    assert sorted(r.id for r in opened) == [1, 4]
    decisions = {r.id: r.decision for r in spark.read.parquet(str(tmp_path / "sink" / "assigned")).collect()}
    assert decisions == {1: "opens", 2: "attached", 3: "existing", 4: "opens"}


def test_corrected_windows_equal_a_batch_report(spark, tmp_path):
    """Rows of any age in every batch, repeated rows and null times: the last version of each window is exact."""
    g = np.random.default_rng(12)
    schema = "model_id string, created_at timestamp, prediction boolean, true_label boolean"
    batches = []
    for i in range(5):
        newest = 100 - 18 * i
        hours = np.concatenate([g.uniform(newest - 18, newest, 60), g.uniform(newest, 100, 12 if i else 0)])
        rows = [(f"m{g.integers(0, 3)}", ago(hours=float(h)), bool(g.random() < 0.5), bool(g.random() < 0.5)) for h in hours]
        batches.append([*rows, rows[0], (None, rows[0][1], True, True), ("m0", None, True, True)])
    stream = source(spark, tmp_path, schema, batches)
    folder = str(tmp_path / "sink")
    streams.run_available(corrections.corrected_windows(stream, folder, "12 hours", "6 hours", "1 hour"), str(tmp_path / "offsets"))
    got = corrections.corrected_report(spark, folder, minimum=1)
    assert got.where("corrected").count() > 0
    late = corrections.late_rows(spark, folder, schema)
    assert 0 < late.count() < 12 * 4 + 5 and late.where("created_at IS NULL").count() == 0
    rows = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    windows = rows.where("created_at IS NOT NULL").groupBy("model_id", F.window("created_at", "12 hours", "6 hours").alias("w")).agg(
        F.count("*").alias("n"), F.count_if(F.col("prediction") & F.col("true_label")).alias("tp"),
        F.count_if("prediction").alias("p"), F.count_if("true_label").alias("y"),
    )
    newest = rows.agg(F.max("created_at")).first()[0]
    want = {
        (r.model_id, r.w.start): (r.n, round(r.tp / r.p, 4) if r.p else 0.0, round(r.tp / r.y, 4) if r.y else 0.0)
        for r in windows.collect() if r.w.end <= newest - timedelta(hours=1)
    }
    assert {(r.model_id, r.window_start): (r.n_samples, r.precision, r.recall) for r in got.collect()} == want


def test_continuous_incidents_read_only_the_days_of_a_batch(spark, tmp_path):
    root = str(tmp_path / "store")
    days = 40
    reports = [(str(i), "m:v1", "f", ago(days=i), 0.5, "PSI", 100, "significant") for i in range(days)]
    files.append_table(spark.createDataFrame(reports, files.TABLES["drift_reports"]), root, "drift_reports")
    stored = files.read_table(spark, root, "drift_reports")
    low, high = F.lit(ago(hours=24)).cast("timestamp"), F.lit(NOW).cast("timestamp")
    pruned = incidents._between(stored, "checked_at", (low, high))
    scan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in scan and pruned.count() == 2
    schema = "id string, model_id string, alert_type string, severity string, triggered_at timestamp"
    alerts = [[(str(i), "m:v1", "feature_drift", "warning", ago(hours=10 - i))] for i in range(4)]
    empty = {
        "deployments": files.TABLES["deployments"], "upstream": files.TABLES["upstream_events"], "accuracy": files.TABLES["accuracy_reports"]
    }

    def context(session):
        return {"drift": files.read_table(session, root, "drift_reports"), **{k: session.createDataFrame([], v) for k, v in empty.items()}}

    folder = str(tmp_path / "sink")
    streams.run_available(streams.continuous_incidents(source(spark, tmp_path, schema, alerts), context, folder), str(tmp_path / "offsets"))
    opened = spark.read.parquet(f"{folder}/incidents")
    assert [r.id for r in opened.collect()] == ["0"] and opened.first().drifting_features == ["f"]
    # What a batch knows of the ones before is one row per model.
    assert spark.read.parquet(f"{folder}/newest/batch=3").count() == 1
