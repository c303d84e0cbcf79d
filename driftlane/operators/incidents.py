"""From alerts to incidents: evidence, de-duplication, diagnosis, remediation.

All alerts are handled at once. What surrounds an alert in time is found by as-of passes
(see ``functions.asof``): "deployed between 30 minutes before and 5 after the alert" is
what is known 5 minutes after it less what was known 30 minutes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.functions.asof import carry_forward, latest_before
from driftlane.functions.ids import model_name
from driftlane.functions.intervals import ALL_LEVELS, DAY_LEVELS, OPEN_END, interval_blocks, micros, point_blocks
from driftlane.session import materialise

_MINUTE = 60_000_000
_HOUR = 60 * _MINUTE
_EVERY_MODEL = "*"
_BLOCK = ["scope", "level", "block"]


def _with_feature(upstream: DataFrame) -> DataFrame:
    """Stored events name the feature in their parameters."""
    if "feature" in upstream.columns:
        return upstream
    return upstream.withColumn("feature", F.get_json_object("parameters", "$.feature"))


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def pending_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts no pass has handled yet, oldest first."""
    return alerts.filter(~F.col("processed")).orderBy("triggered_at", "id")


# --- evidence ---------------------------------------------------------------------


def _between(df: DataFrame, column: str, bounds: tuple[Column, Column]) -> DataFrame:
    """Rows of a time range; stored tables leave out the folders of other days."""
    low, high = bounds
    rows = df.where(F.col(column).between(low, high))
    return rows.where(F.col("dt").between(F.to_date(low), F.to_date(high))) if "dt" in df.columns else rows


def _feature_panes(alerts: DataFrame, drift: DataFrame, hours: int) -> DataFrame:
    """``scope, at, pane``: per model and hour that has alerts, which features drifted in the ``hours`` before.

    A report is reduced to its hour once. A pane has one entry per feature: whether it
    drifted in one of the whole hours in between, when first in the hour itself, and
    when last in the hour that the look-back begins in.
    """
    drifting = drift.where(F.col("status").isin("moderate", "significant") & (F.col("feature_name") != "_all_features"))
    at = micros(F.col("checked_at"))
    hourly = drifting.groupBy(
        F.col("model_id").alias("scope"), F.floor(at / _HOUR).alias("hour"), F.col("feature_name").alias("feature")
    ).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    asked = alerts.select(F.col("model_id").alias("scope"), F.floor(micros(F.col("triggered_at")) / _HOUR).alias("of")).distinct()
    asked = asked.select("scope", "of", F.explode(F.sequence(F.lit(0), F.lit(hours))).alias("back"))
    met = asked.withColumn("hour", F.col("of") - F.col("back")).join(hourly, ["scope", "hour"])
    per_feature = met.groupBy("scope", "of", "feature").agg(
        F.max(F.col("back").between(1, hours - 1)).alias("inside"),
        F.min(F.when(F.col("back") == 0, F.col("first"))).alias("first"),
        F.max(F.when(F.col("back") == hours, F.col("last"))).alias("last"),
    )
    return per_feature.groupBy("scope", "of").agg(
        F.collect_list(F.struct("feature", "inside", "first", "last")).alias("pane")
    ).select("scope", (F.col("of") * _HOUR).alias("at"), F.struct("of", F.col("pane").alias("features")).alias("pane"))


def _model_context(
    alerts: DataFrame, deployments: DataFrame, drift: DataFrame, accuracy: DataFrame, minutes: int, forward: int, hours: int
) -> DataFrame:
    """Per alert what its own model had around it, from one as-of pass over events and alerts.

    An alert asks at the four ends of its two windows. Counts are differences of running
    counts; the newest row counts if it lies in the window.
    """
    deployed, checked, reported = (micros(F.col(c)) for c in ("deployed_at", "checked_at", "created_at"))
    kinds = {
        "tie_d": dict(deployments.dtypes)["id"], "tie_a": dict(accuracy.dtypes)["id"],
        "n_deployments": "bigint", "n_reports": "bigint",
    }
    model = F.col("model_id").alias("scope")

    def events(df: DataFrame, at: Column, **values: Column) -> DataFrame:
        rows = df.where(F.col("model_id").isNotNull())
        return rows.select(model, at.alias("at"), F.lit(0).alias("side"), *[v.alias(k) for k, v in values.items()])

    at = micros(F.col("triggered_at"))
    ends = {  # what comes at the very time counts at the end of a window, not before its start
        "deploy_end": (at + forward * _MINUTE, 1), "deploy_start": (at - minutes * _MINUTE, -1),
        "end": (at, 1), "start": (at - hours * _HOUR, -1),
    }
    probes = alerts.select(model, F.col("id").alias("alert"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("end"), t.alias("at"), F.lit(side).alias("side")) for k, (t, side) in ends.items()
    ])).alias("p")).select("scope", "alert", "p.*")
    parts = (
        events(
            deployments, deployed, tie_d=F.col("id"), n_deployments=F.lit(1).cast("bigint"),
            deployment=F.struct("deployed_at", "id", "version"),
        ),
        events(drift, checked, n_reports=F.lit(1).cast("bigint")),
        events(
            accuracy, reported, tie_a=F.col("id"),
            accuracy=F.struct(
                "created_at", "id", "f1", "precision", "recall", "roc_auc", "n_samples", _or_null(accuracy, "window_end", "timestamp").alias("window_end"),
            ),
        ),
        _feature_panes(alerts, drift, hours).withColumn("side", F.lit(-2)),
    )
    combined = probes
    for part in parts:
        combined = combined.unionByName(part, allowMissingColumns=True)
    combined = combined.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    carried = carry_forward(
        combined, ["scope"], ["at", "side", "tie_d", "tie_a"], newest=["deployment", "accuracy", "pane"], sums=["n_deployments", "n_reports"]
    ).where(F.col("end").isNotNull())

    def at_end(end: str, column: str) -> Column:
        return F.max(F.when(F.col("end") == end, F.col(column)))

    found = carried.groupBy("alert").agg(
        (at_end("deploy_end", "n_deployments") - at_end("deploy_start", "n_deployments")).alias("n_deployments"),
        (at_end("end", "n_reports") - at_end("start", "n_reports")).alias("n_reports"),
        at_end("end", "at").alias("at"), at_end("deploy_end", "deployment").alias("deployment"),
        at_end("end", "accuracy").alias("accuracy"), at_end("end", "pane").alias("pane"),
    )
    start = F.col("at") - hours * _HOUR
    in_hour = F.col("pane.of") == F.floor(F.col("at") / _HOUR)
    drifting = F.filter("pane.features", lambda x: x["inside"] | F.coalesce(x["first"] <= F.col("at"), F.lit(False)) | F.coalesce(x["last"] >= start, F.lit(False)))
    return found.select(
        "alert", "n_deployments", "n_reports",
        F.when(F.col("n_deployments") > 0, F.col("deployment")).alias("deployment"),
        F.when(micros(F.col("accuracy.created_at")) >= start, F.col("accuracy")).alias("accuracy"),
        F.sort_array(F.when(in_hour, F.transform(drifting, lambda x: x["feature"]))).alias("drifting_features"),
    )


def _upstream_context(alerts: DataFrame, upstream: DataFrame, minutes: int, forward: int) -> DataFrame:
    """Per alert how many upstream events are under way and the one that started last.

    Both change only where an event starts or ends. They are worked out there, for the
    few events, through interval blocks; an alert takes what holds since the last change.
    """
    start = micros(F.col("started_at")) - forward * _MINUTE
    after = F.coalesce(micros(F.col("ended_at")) + minutes * _MINUTE + 1, F.lit(OPEN_END))
    event = F.struct("started_at", "id", "event_type", "feature").alias("upstream")
    spans = materialise(upstream.select(event, start.alias("start"), after.alias("after")).where("start < after"))
    changes = spans.select(F.explode(F.array("start", "after")).alias("at")).distinct().where(F.col("at") < OPEN_END)
    per_block = interval_blocks(spans, F.col("start"), F.col("after") - 1, ALL_LEVELS, ["upstream"]).groupBy("level", "block").agg(
        F.count("*").alias("n"), F.max("upstream").alias("upstream")
    )
    state = changes.join(
        point_blocks(changes, F.col("at"), ALL_LEVELS, ["at"]).join(per_block, ["level", "block"]).groupBy("at").agg(
            F.sum("n").alias("n"), F.max("upstream").alias("upstream")
        ), "at", "left",
    ).select("at", F.lit(0).alias("side"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "upstream").alias("state"))
    probes = alerts.select(F.col("id").alias("alert"), micros(F.col("triggered_at")).alias("at"), F.lit(1).alias("side"))
    carried = carry_forward(probes.unionByName(state, allowMissingColumns=True), [], ["at", "side"], newest=["state"])
    return carried.where("side = 1").groupBy(F.col("alert")).agg(F.max("state").alias("state")).select(
        "alert", F.col("state.n").alias("n_upstream"), F.col("state.upstream").alias("upstream")
    )


def gather_evidence(
    alerts: DataFrame,
    deployments: DataFrame,
    upstream: DataFrame,
    drift: DataFrame,
    accuracy: DataFrame,
    deploy_minutes: int = C.DEPLOY_WINDOW_MINUTES,
    upstream_minutes: int = C.UPSTREAM_WINDOW_MINUTES,
    forward_minutes: int = C.FORWARD_TOLERANCE_MINUTES,
    lookback_hours: int = C.LOOKBACK_HOURS,
) -> DataFrame:
    """Per alert: deployments and upstream events around it, drift and accuracy before it.

    Reports, deployments and alerts are each read into one as-of pass; nothing is paired,
    and only the time range of the given alerts is read. The feature set is bounded by
    the features a model has.
    """
    at = micros(F.col("triggered_at"))
    first, last = alerts.agg(F.min(at), F.max(at)).first()

    def around(minutes_before: int, minutes_after: int) -> tuple[Column, Column]:
        if first is None:
            return F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")
        return F.timestamp_micros(F.lit(first - minutes_before * _MINUTE)), F.timestamp_micros(F.lit(last + minutes_after * _MINUTE))

    recent = around(lookback_hours * 60, 0)
    model = _model_context(
        alerts, _between(deployments, "deployed_at", around(deploy_minutes, forward_minutes)),
        _between(drift, "checked_at", recent), _between(accuracy, "created_at", recent),
        deploy_minutes, forward_minutes, lookback_hours,
    )
    low, high = around(upstream_minutes, forward_minutes)
    met = _with_feature(upstream).where((F.col("started_at") <= high) & (F.col("ended_at").isNull() | (F.col("ended_at") >= low)))
    found = model.join(_upstream_context(alerts, met, upstream_minutes, forward_minutes), "alert")
    features = F.coalesce("drifting_features", F.array().cast("array<string>"))
    return alerts.join(found, alerts["id"] == found["alert"], "left").select(
        *alerts.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_deployments", "n_upstream", "n_reports")],
        "deployment", "upstream", "accuracy",
        features.alias("drifting_features"),
        F.size(features).alias("drifting_count"),
        F.array_contains(features, "_prediction").alias("prediction_drift"),
    )


def evidence_items(alerts: DataFrame, deployments: DataFrame, upstream: DataFrame) -> DataFrame:
    """The single deployments and upstream events behind each alert, as long rows.

    Meant for the few alerts that open an incident. Returns ``alert_id, kind, item_id,
    item_at, label, feature``, of deployments ``git_commit, is_current`` and of upstream
    events ``ended_at, parameters``, as far as the tables have them.
    """
    forward = C.FORWARD_TOLERANCE_MINUTES * _MINUTE
    upstream = _with_feature(upstream)
    deployed, started = micros(F.col("deployed_at")), micros(F.col("started_at"))
    ended = F.coalesce(micros(F.col("ended_at")) + C.UPSTREAM_WINDOW_MINUTES * _MINUTE, F.lit(OPEN_END))
    items = interval_blocks(
        deployments, deployed - forward, deployed + C.DEPLOY_WINDOW_MINUTES * _MINUTE, DAY_LEVELS,
        [F.col("model_id").alias("scope"), F.lit("deployment").alias("kind"), F.col("id").alias("item_id"),
         F.col("deployed_at").alias("item_at"), F.col("version").alias("label"),
         F.lit(None).cast("string").alias("feature"), _or_null(deployments, "git_commit", "string").alias("git_commit"),
         _or_null(deployments, "is_current", "boolean").alias("is_current")],
    ).unionByName(
        interval_blocks(
            upstream, started - forward, ended, ALL_LEVELS,
            [F.lit(_EVERY_MODEL).alias("scope"), F.lit("upstream").alias("kind"), F.col("id").alias("item_id"),
             F.col("started_at").alias("item_at"), F.col("event_type").alias("label"), "feature", "ended_at",
             _or_null(upstream, "parameters", "string").alias("parameters")],
        ), allowMissingColumns=True,
    )
    at, alert = micros(F.col("triggered_at")), F.col("id").alias("alert_id")
    probes = point_blocks(alerts, at, DAY_LEVELS, [alert, F.col("model_id").alias("scope")]).unionByName(
        point_blocks(alerts, at, ALL_LEVELS, [alert, F.lit(_EVERY_MODEL).alias("scope")])
    )
    return probes.join(items, _BLOCK).select("alert_id", *[c for c in items.columns if c not in _BLOCK])


def item_lists(items: DataFrame) -> DataFrame:
    """``alert_id, recent_deployments, active_injections``: all items of an alert, the newest first."""

    def newest_first(kind: str, *fields: Column) -> Column:
        row = F.struct("item_at", "item_id", F.struct(*fields).alias("item"))
        listed = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, row)), asc=False)
        return F.transform(listed, lambda x: x["item"])

    item_id, label = F.col("item_id").alias("id"), F.col("label")
    return items.groupBy("alert_id").agg(
        newest_first(
            "deployment", item_id, label.alias("version"), F.col("item_at").alias("deployed_at"), F.col("git_commit"), F.col("is_current"),
        ).alias("recent_deployments"),
        newest_first(
            "upstream", item_id, label.alias("event_type"), F.col("item_at").alias("started_at"), F.col("ended_at"), F.col("parameters"),
        ).alias("active_injections"),
    )


# --- diagnosis ----------------------------------------------------------------------


def _first_match(rules: list[tuple[Column, dict[str, Column]]], name: str) -> Column:
    chain = None
    for condition, values in rules:
        chain = F.when(condition, values[name]) if chain is None else chain.when(condition, values[name])
    return chain


def _rule_table() -> list[tuple[Column, dict[str, Column]]]:
    """The five rules in order of priority; the first that applies decides."""
    drop = F.col("alert_type") == "accuracy_drop"
    count, features = F.col("drifting_count"), F.col("drifting_features")
    version, event, feature = F.col("deployment.version"), F.col("upstream.event_type"), F.col("upstream.feature")

    def outcome(rule: str, confidence: float, action: str, hypothesis: Column) -> dict[str, Column]:
        return {
            "rule_name": F.lit(rule), "confidence": F.lit(confidence),
            "recommended_action": F.lit(action), "hypothesis": hypothesis,
        }

    return [
        (
            (F.col("n_deployments") > 0) & (drop | F.col("prediction_drift")),
            outcome("bad_deploy", 0.90, "rollback", F.format_string(
                f"{C.BAD_DEPLOYMENT}: scores or predictions got worse right after version %s went live.", version)),
        ),
        (
            F.col("n_upstream") > 0,
            outcome("upstream_data_issue", 0.85, "fix_upstream_data", F.format_string(
                f"{C.UPSTREAM_FAILURE}: event %s was under way and touches feature %s.",
                event, F.coalesce(feature, F.lit("unknown")))),
        ),
        (
            (count == 1) & ~drop,
            outcome("single_feature_drift", 0.65, "monitor", F.format_string(
                f"{C.SINGLE_DRIFT}: only %s has moved, and no drop in accuracy goes with it so far.", F.get(features, F.lit(0)))),
        ),
        (
            (count >= 2) & (drop | F.col("accuracy").isNotNull()),
            outcome("broad_concept_drift", 0.70, "retrain", F.format_string(
                f"{C.BROAD_DRIFT}: %d features have moved (%s), and accuracy was measured or has dropped.", count, F.array_join(features, ", "))),
        ),
        (
            F.lit(True),
            outcome("unclear_cause", 0.20, "escalate", F.lit(
                f"{C.UNCLEAR_CAUSE}: no deployment, upstream event or drift pattern fits this alert.")),
        ),
    ]


def diagnose(evidence: DataFrame) -> DataFrame:
    """Adds hypothesis, confidence, recommended action and rule name."""
    rules = _rule_table()
    names = ("rule_name", "confidence", "recommended_action", "hypothesis")
    return evidence.select("*", *[_first_match(rules, n).alias(n) for n in names])


def reasoning_log(diagnosed: DataFrame) -> DataFrame:
    """Adds the ordered steps that led to the diagnosis as an array of text."""

    def stamp(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def number(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("None")

    features = F.array_join("drifting_features", ", ")
    steps = F.array(
        F.format_string(
            "Step 1: alert %s (%s, %s) of model %s, triggered at %s.",
            F.col("id").cast("string"), F.col("alert_type"), F.col("severity"), F.col("model_id"), stamp("triggered_at"),
        ),
        F.when(
            F.col("n_deployments") > 0,
            F.format_string(
                "Step 2: deployments near the alert: %d, the newest is %s of %s.",
                F.col("n_deployments"), F.col("deployment.version"), stamp("deployment.deployed_at"),
            ),
        ).otherwise("Step 2: deployments near the alert: none."),
        F.when(
            F.col("n_upstream") > 0,
            F.format_string(
                "Step 3: upstream events under way: %d, the newest is %s.", F.col("n_upstream"), F.col("upstream.event_type"),
            ),
        ).otherwise("Step 3: upstream events under way: none."),
        F.format_string(
            "Step 4: drifting features: %d [%s]; predictions drift: %s.",
            F.col("drifting_count"), features, F.col("prediction_drift").cast("string"),
        ),
        F.when(
            F.col("accuracy").isNotNull(),
            F.format_string(
                "Step 5: newest accuracy: F1 %s, precision %s, recall %s over %d samples.",
                number("accuracy.f1"), number("accuracy.precision"), number("accuracy.recall"),
                F.col("accuracy.n_samples"),
            ),
        ).otherwise("Step 5: newest accuracy: none in the look-back."),
        F.format_string(
            "Step 6: rule %s applies with confidence %.2f and asks to %s.",
            F.col("rule_name"), F.col("confidence"), F.col("recommended_action"),
        ),
    )
    return diagnosed.withColumn("reasoning_log", steps)


def shorten_evidence(diagnosed: DataFrame, steps: int = 5, features: int = 10) -> DataFrame:
    """A short form for explanations: the last steps and the first features, with a note."""
    count = F.col("drifting_count")
    return diagnosed.withColumn(
        "reasoning_log", F.slice("reasoning_log", F.greatest(F.size("reasoning_log") - (steps - 1), F.lit(1)), F.lit(steps))
    ).withColumn(
        "note", F.when(count > features, F.format_string("%d more features left out", count - features))
    ).withColumn("drifting_features", F.slice("drifting_features", 1, features))


def shorten_items(items: DataFrame, keep: int = 5, width: int = 200) -> DataFrame:
    """The newest few items per alert and kind, long labels cut with a mark."""
    newest = Window.partitionBy("alert_id", "kind").orderBy(F.desc("item_at"), F.desc("item_id"))
    cut = F.when(F.length("label") > width, F.concat(F.substring("label", 1, width), F.lit(f"… {C.TRUNCATED}")))
    return (
        items.withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= keep)
        .drop("_r")
        .withColumn("label", F.coalesce(cut, F.col("label")))
    )


# --- de-duplication -------------------------------------------------------------------


def assign_alerts(alerts: DataFrame, incidents: DataFrame, minutes: int = C.DEDUP_MINUTES) -> DataFrame:
    """What one pass does with each unprocessed alert, without a loop.

    An alert joins the newest incident of its model if that was created no earlier
    than ``minutes`` before the alert. Alerts are taken in time order, so of those
    left over the first per model opens an incident stamped now, and the rest join
    it. Adds ``decision`` (existing, opens, attached), ``incident_id`` and
    ``opened_by``.
    """
    newest = materialise(
        incidents.groupBy("model_id").agg(
            F.max(F.struct(F.col("created_at").alias("at"), F.col("id").alias("id"))).alias("_newest")
        )
    )
    window = F.make_dt_interval(mins=F.lit(minutes))
    matched = F.col("_newest.at") >= F.col("triggered_at") - window
    pending = alerts.filter(~F.col("processed")).join(newest, "model_id", "left").withColumn(
        "_matched", F.coalesce(matched, F.lit(False))
    )
    first = materialise(
        pending.filter(~F.col("_matched")).groupBy("model_id").agg(
            F.min(F.struct("triggered_at", "id"))["id"].alias("opened_by")
        )
    )
    decided = pending.join(first, "model_id", "left")
    decision = (
        F.when(F.col("_matched"), "existing").when(F.col("id") == F.col("opened_by"), "opens").otherwise("attached")
    )
    return decided.select(
        *alerts.columns,
        decision.alias("decision"),
        F.when(F.col("_matched"), F.col("_newest.id")).alias("incident_id"),
        F.when(~F.col("_matched"), F.col("opened_by")).alias("opened_by"),
    )


def incidents_as_of(alerts: DataFrame, incidents: DataFrame, minutes: int = C.DEDUP_MINUTES) -> DataFrame:
    """All alerts with the ``incident_id`` of their model's newest incident at that time, if it was within ``minutes``.

    For replaying history: unlike ``assign_alerts`` it doesn't see what came later.
    """
    found = latest_before(
        alerts, incidents, ["model_id"], "triggered_at", "created_at", "id", F.struct("created_at", F.col("id").alias("incident")), "newest"
    ).withColumnRenamed("id", "_alert")
    recent = F.col("newest.created_at") >= F.col("triggered_at") - F.make_dt_interval(mins=F.lit(minutes))
    return alerts.join(found, alerts["id"] == found["_alert"]).select(
        *alerts.columns, F.when(recent, F.col("newest.incident")).alias("incident_id")
    )


# --- remediation ----------------------------------------------------------------------


def rollback_targets(deployments: DataFrame) -> DataFrame:
    """Per tenant the serving deployment and the newest other one, if any.

    Serving is the newest flagged row, or the newest of all when none is flagged.
    """
    rows = deployments.select(
        model_name(F.col("model_id")).alias("model_name"),
        F.struct("deployed_at", "id", "version").alias("d"), "is_current",
    )
    serving = materialise(
        rows.groupBy("model_name").agg(
            F.coalesce(F.max(F.when(F.col("is_current"), F.col("d"))), F.max("d")).alias("serving")
        )
    )
    others = rows.join(serving, "model_name").filter(F.col("d.id") != F.col("serving.id"))
    target = others.groupBy("model_name").agg(F.max("d").alias("target"))
    return materialise(
        serving.join(target, "model_name", "left").select(
            "model_name",
            F.col("serving.version").alias("serving_version"), F.col("serving.id").alias("serving_id"),
            F.col("target.version").alias("target_version"), F.col("target.id").alias("target_id"),
            F.col("target.deployed_at").alias("target_at"),
        )
    )


def remediate(diagnosed: DataFrame, targets: DataFrame, threshold: float = C.AUTO_REMEDIATE_CONFIDENCE) -> DataFrame:
    """Rolls back only on a confident rollback diagnosis with a version to go back to.

    A ``reasoning_log`` goes on with what was checked, found and done.
    """
    joined = diagnosed.withColumn("model_name", model_name(F.col("model_id"))).join(targets, "model_name", "left")
    wanted = (F.col("recommended_action") == "rollback") & (F.col("confidence") >= threshold)
    possible = F.col("target_id").isNotNull()
    stuck = wanted & ~possible
    asked = F.format_string(
        f"Step 7: a rollback needs confidence {threshold:.2f}; asked for is %s with %.2f.", F.col("recommended_action"), F.col("confidence")
    )
    done = F.when(stuck, F.array(asked, F.lit("Step 8: there is no other version to go back to, so the incident is escalated."))).when(
        wanted, F.array(
            asked,
            F.format_string(
                "Step 8: the version to go back to is %s of %s.", F.col("target_version"), F.date_format("target_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            ),
            F.format_string("Step 9: resolved by going back to %s.", F.col("target_version")),
        ),
    ).otherwise(F.array(asked, F.lit("Step 8: nothing is done by itself, so the incident is escalated.")))
    log = [F.concat("reasoning_log", done).alias("reasoning_log")] if "reasoning_log" in diagnosed.columns else []
    return joined.select(
        *[c for c in diagnosed.columns if c not in ("hypothesis", "confidence", "recommended_action", "reasoning_log")], *log,
        F.when(
            stuck, F.concat("hypothesis", F.lit(f" ({C.ROLLBACK_IMPOSSIBLE}: there is no other version to go back to)"))
        ).otherwise(F.col("hypothesis")).alias("hypothesis"),
        F.when(stuck, 0.20).otherwise(F.col("confidence")).alias("confidence"),
        F.when(stuck, "escalate").otherwise(F.col("recommended_action")).alias("recommended_action"),
        F.when(wanted & possible, "auto_resolved").otherwise("escalated").alias("status"),
        F.when(wanted & possible, F.col("target_version")).alias("rollback_to"),
    )


def incident_pass(
    alerts: DataFrame,
    existing: DataFrame,
    deployments: DataFrame,
    upstream: DataFrame,
    drift: DataFrame,
    accuracy: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """One whole pass: new incidents, and what became of every unprocessed alert."""
    assigned = assign_alerts(alerts, existing)
    opening = materialise(assigned.filter(F.col("decision") == "opens").select(*alerts.columns))
    evidence = gather_evidence(opening, deployments, upstream, drift, accuracy)
    listed = item_lists(evidence_items(opening, deployments, upstream))
    decided = remediate(reasoning_log(diagnose(evidence)), rollback_targets(deployments))
    decided = decided.join(listed, decided["id"] == listed["alert_id"], "left").drop("alert_id")
    attached = assigned.groupBy("opened_by").agg(F.count_if(F.col("decision") == "attached").alias("n_attached"))
    incidents = decided.join(attached, decided["id"] == attached["opened_by"], "left").drop("opened_by")
    return incidents, assigned


def incident_rows(opened: DataFrame, as_of) -> DataFrame:
    """New incidents in the stored schema; the evidence is a JSON document, what no model wrote is null."""
    none = F.lit(None)

    def listed(name: str) -> Column:
        kind = dict(opened.dtypes)[name]
        return F.coalesce(name, F.array().cast(kind)).alias(name)

    # The field names of stored evidence documents.
    evidence = F.to_json(
        F.struct(
            F.struct("id", "model_id", "alert_type", "severity", "triggered_at", _or_null(opened, "details", "string").alias("details")).alias("alert"),
            listed("recent_deployments"), listed("active_injections"),
            F.struct(
                F.col("n_reports").alias("total_reports_evaluated"), "drifting_features", "drifting_count", "prediction_drift",
            ).alias("drift_context"),
            F.struct(*[F.col(f"accuracy.{c}").alias(c) for c in ("f1", "precision", "recall", "roc_auc", "n_samples", "window_end")]).alias(
                "accuracy_context"
            ),
            "rule_name", "reasoning_log", "rollback_to", "n_reports",
        ), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"},
    )
    resolved = F.when(F.col("status") == "auto_resolved", F.lit(as_of))
    alert = F.col("id").cast("string")
    return opened.select(
        F.concat(F.lit("incident-"), alert).alias("id"), alert.alias("alert_id"), "model_id", "hypothesis", "confidence",
        evidence.alias("evidence"), "recommended_action", "status", F.lit(as_of).alias("created_at"),
        resolved.alias("resolved_at"), none.cast("string").alias("llm_explanation"),
        none.cast("double").alias("llm_confidence"), none.cast("string").alias("llm_suggested_action"),
    )


def attached_alerts(assigned: DataFrame) -> DataFrame:
    """``incident_id, alert_id`` for every alert that belongs to an incident, old or new, as text."""
    new = F.concat(F.lit("incident-"), F.col("opened_by").cast("string"))
    return assigned.select(
        F.coalesce(F.col("incident_id").cast("string"), new).alias("incident_id"), F.col("id").cast("string").alias("alert_id")
    )


def alerts_after_pass(alerts: DataFrame, assigned: DataFrame) -> DataFrame:
    """All alerts, those that the pass decided on marked as processed."""
    handled = assigned.select("id", F.lit(True).alias("_handled"))
    return alerts.join(handled, "id", "left").withColumn(
        "processed", F.col("processed") | F.coalesce("_handled", F.lit(False))
    ).select(*alerts.columns)
