"""Evidence, diagnosis and incident queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftlane.functions.asof import latest_before
from driftlane.operators import incidents as I
from driftlane.plans.registry import query, stamp
from driftlane.plans.view_sql import stamp_sql
from driftlane.session import shared_folder
from driftlane.sources import driver_tables as T
from driftlane.sources import files

_EVIDENCE = """
dep AS (SELECT a.id, count(*) AS n, arg_max(d.version, (d.deployed_at, d.id)) AS version, max(d.deployed_at) AS at
        FROM alerts a JOIN deploys d ON a.model_id = d.model_id
         AND d.deployed_at BETWEEN a.triggered_at - INTERVAL 30 MINUTE AND a.triggered_at + INTERVAL 5 MINUTE
        GROUP BY a.id),
ups AS (SELECT a.id, count(*) AS n, arg_max(u.event_type, (u.started_at, u.id)) AS event_type,
               arg_max(u.feature, (u.started_at, u.id)) AS feature
        FROM alerts a JOIN upstream u ON u.started_at <= a.triggered_at + INTERVAL 5 MINUTE
         AND (u.ended_at IS NULL OR u.ended_at >= a.triggered_at - INTERVAL 30 MINUTE) GROUP BY a.id),
dri AS (SELECT a.id, count(*) AS n, list_sort(list(DISTINCT d.feature_name)
                 FILTER (d.status IN ('moderate', 'significant') AND d.feature_name <> '_all_features')) AS features
        FROM alerts a JOIN drifts d ON a.model_id = d.model_id
         AND d.checked_at BETWEEN a.triggered_at - INTERVAL 24 HOUR AND a.triggered_at GROUP BY a.id),
acc AS (SELECT a.id, arg_max(r, (r.created_at, r.id)) AS r
        FROM alerts a JOIN accuracies r ON a.model_id = r.model_id
         AND r.created_at BETWEEN a.triggered_at - INTERVAL 24 HOUR AND a.triggered_at GROUP BY a.id),
evidence AS (SELECT a.*, coalesce(dep.n, 0) AS n_deployments, dep.version, dep.at AS deployed_at,
                coalesce(ups.n, 0) AS n_upstream, ups.event_type, ups.feature, coalesce(dri.n, 0) AS n_reports,
                coalesce(dri.features, []) AS features, len(coalesce(dri.features, [])) AS k,
                list_contains(coalesce(dri.features, []), '_prediction') AS prediction_drift, acc.r
             FROM alerts a LEFT JOIN dep USING (id) LEFT JOIN ups USING (id) LEFT JOIN dri USING (id)
             LEFT JOIN acc USING (id)),
ruled AS (SELECT *, CASE WHEN n_deployments > 0 AND (alert_type = 'accuracy_drop' OR prediction_drift) THEN 1
                WHEN n_upstream > 0 THEN 2 WHEN k = 1 AND alert_type <> 'accuracy_drop' THEN 3
                WHEN k >= 2 AND (alert_type = 'accuracy_drop' OR r IS NOT NULL) THEN 4 ELSE 5 END AS rule
          FROM evidence),
diagnosed AS (SELECT *,
  ['bad_deploy', 'upstream_data_issue', 'single_feature_drift', 'broad_concept_drift', 'unclear_cause'][rule]
    AS rule_name,
  CAST([0.90, 0.85, 0.65, 0.70, 0.20][rule] AS DOUBLE) AS confidence,
  ['rollback', 'fix_upstream_data', 'monitor', 'retrain', 'escalate'][rule] AS recommended_action,
  CASE rule
   WHEN 1 THEN 'Bad deployment: scores or predictions got worse right after version ' || version || ' went live.'
   WHEN 2 THEN 'Upstream data pipeline failure: event ' || event_type || ' was under way and touches feature ' ||
        coalesce(feature, 'unknown') || '.'
   WHEN 3 THEN 'Isolated single-feature input drift: only ' || features[1] ||
        ' has moved, and no drop in accuracy goes with it so far.'
   WHEN 4 THEN 'Broad concept drift: ' || k || ' features have moved (' || array_to_string(features, ', ') ||
        '), and accuracy was measured or has dropped.'
   ELSE 'Unclear root cause: no deployment, upstream event or drift pattern fits this alert.'
  END AS hypothesis FROM ruled)"""

_LOG = f"""
logged AS (SELECT *, [
  'Step 1: alert ' || id || ' (' || alert_type || ', ' || severity || ') of model ' || model_id || ', triggered at ' ||
    strftime(triggered_at, '%Y-%m-%dT%H:%M:%S.%f') || '.',
  CASE WHEN n_deployments > 0 THEN 'Step 2: deployments near the alert: ' || n_deployments || ', the newest is ' ||
    version || ' of ' || strftime(deployed_at, '%Y-%m-%dT%H:%M:%S.%f') || '.'
    ELSE 'Step 2: deployments near the alert: none.' END,
  CASE WHEN n_upstream > 0 THEN 'Step 3: upstream events under way: ' || n_upstream || ', the newest is ' || event_type || '.'
    ELSE 'Step 3: upstream events under way: none.' END,
  'Step 4: drifting features: ' || k || ' [' || array_to_string(features, ', ') ||
    ']; predictions drift: ' || CAST(prediction_drift AS VARCHAR) || '.',
  CASE WHEN r IS NOT NULL THEN 'Step 5: newest accuracy: F1 ' || coalesce(printf('%.4f', r.f1), 'None') ||
    ', precision ' || coalesce(printf('%.4f', r."precision"), 'None') || ', recall ' || printf('%.4f', r.recall) ||
    ' over ' || r.n_samples || ' samples.' ELSE 'Step 5: newest accuracy: none in the look-back.' END,
  'Step 6: rule ' || rule_name || ' applies with confidence ' || printf('%.2f', confidence) || ' and asks to ' ||
    recommended_action || '.'] AS steps FROM diagnosed)"""

_ASSIGNED = """
newest AS (SELECT model_id, max(created_at) AS at, arg_max(id, (created_at, id)) AS incident FROM incidents
           GROUP BY model_id),
matching AS (SELECT a.*, n.incident, coalesce(n.at >= a.triggered_at - INTERVAL 15 MINUTE, FALSE) AS matched
             FROM alerts a LEFT JOIN newest n USING (model_id) WHERE NOT a.processed),
openers AS (SELECT model_id, arg_min(id, (triggered_at, id)) AS opener FROM matching WHERE NOT matched GROUP BY model_id),
assigned AS (SELECT m.id, m.model_id, m.triggered_at,
               CASE WHEN matched THEN 'existing' WHEN m.id = o.opener THEN 'opens' ELSE 'attached' END AS decision,
               CASE WHEN matched THEN m.incident END AS incident_id, CASE WHEN NOT matched THEN o.opener END AS opened_by
             FROM matching m LEFT JOIN openers o USING (model_id))"""

_TARGETS = """
named AS (SELECT *, split_part(model_id, ':', 1) AS model_name FROM deploys),
serving AS (SELECT model_name, coalesce(arg_max(id, (deployed_at, id)) FILTER (is_current), arg_max(id, (deployed_at, id)))
              AS serving_id FROM named GROUP BY model_name),
targets AS (SELECT s.model_name, s.serving_id, t.id AS target_id, t.version AS target_version, t.deployed_at AS target_at
            FROM serving s LEFT JOIN (SELECT n.*, row_number() OVER (PARTITION BY n.model_name
                 ORDER BY n.deployed_at DESC, n.id DESC) AS r FROM named n JOIN serving s2 USING (model_name)
                 WHERE n.id <> s2.serving_id) t ON t.model_name = s.model_name AND t.r = 1)"""


def _existing(spark, sf_dir):
    """All incidents, dated 16 days back, so that the later alerts are new."""
    return T.incidents(spark, sf_dir).withColumn("created_at", F.col("created_at") - F.expr("INTERVAL 16 DAYS"))


_OLD = _ASSIGNED.replace(
    "FROM incidents", "FROM (SELECT * REPLACE (created_at - INTERVAL 16 DAY AS created_at) FROM incidents)"
)


def _evidence(spark, sf_dir):
    return I.gather_evidence(
        T.alerts(spark, sf_dir), T.deployments(spark, sf_dir), T.upstream_events(spark, sf_dir),
        T.drift_reports(spark, sf_dir), T.accuracy_reports(spark, sf_dir),
    )


@query(
    "alert_evidence",
    f"""
WITH {_EVIDENCE}
SELECT id, n_deployments, version, {stamp_sql("deployed_at")} AS deployed_at, n_upstream, event_type, feature,
       n_reports, array_to_string(features, ',') AS drifting_features, CAST(k AS INT) AS drifting_count,
       prediction_drift, round(r.f1, 6) AS f1, r.n_samples AS n_samples FROM evidence""",
)
def alert_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select(
        "id", "n_deployments", F.col("deployment.version").alias("version"),
        stamp("deployment.deployed_at").alias("deployed_at"), "n_upstream",
        F.col("upstream.event_type").alias("event_type"), F.col("upstream.feature").alias("feature"), "n_reports",
        F.array_join("drifting_features", ",").alias("drifting_features"), "drifting_count", "prediction_drift",
        F.round("accuracy.f1", 6).alias("f1"), F.col("accuracy.n_samples").alias("n_samples"),
    )


@query(
    "alert_diagnosis",
    f"WITH {_EVIDENCE}\nSELECT id, model_id, rule_name, confidence, recommended_action, hypothesis FROM diagnosed",
)
def alert_diagnosis(spark, sf_dir):
    return I.diagnose(_evidence(spark, sf_dir)).select(
        "id", "model_id", "rule_name", "confidence", "recommended_action", "hypothesis"
    )


@query(
    "reasoning_log", f"WITH {_EVIDENCE},{_LOG}\nSELECT id, array_to_string(steps, ' | ') AS reasoning FROM logged"
)
def reasoning_log(spark, sf_dir):
    logged = I.reasoning_log(I.diagnose(_evidence(spark, sf_dir)))
    return logged.select("id", F.array_join("reasoning_log", " | ").alias("reasoning"))


@query(
    "shortened_evidence",
    f"""WITH {_EVIDENCE},{_LOG}
SELECT id, array_to_string(steps[2:6], ' | ') AS reasoning, array_to_string(features[1:3], ',') AS drifting_features,
       CASE WHEN k > 3 THEN (k - 3) || ' more features left out' END AS note FROM logged""",
)
def shortened_evidence(spark, sf_dir):
    short = I.shorten_evidence(I.reasoning_log(I.diagnose(_evidence(spark, sf_dir))), features=3)
    return short.select(
        "id", F.array_join("reasoning_log", " | ").alias("reasoning"),
        F.array_join("drifting_features", ",").alias("drifting_features"), "note",
    )


@query(
    "alert_assignment",
    f"WITH {_OLD}\nSELECT id, model_id, decision, incident_id, opened_by FROM assigned",
)
def alert_assignment(spark, sf_dir):
    assigned = I.assign_alerts(T.alerts(spark, sf_dir), _existing(spark, sf_dir))
    return assigned.select("id", "model_id", "decision", "incident_id", "opened_by")


@query(
    "rollback_targets",
    f"WITH {_TARGETS}\nSELECT model_name, serving_id, target_id, target_version FROM targets",
)
def rollback_targets(spark, sf_dir):
    return I.rollback_targets(T.deployments(spark, sf_dir)).select(
        "model_name", "serving_id", "target_id", "target_version"
    )


_PASS = f"""
WITH {_EVIDENCE},{_LOG},{_OLD},{_TARGETS},
opened AS (SELECT d.*, split_part(d.model_id, ':', 1) AS model_name FROM diagnosed d
           JOIN assigned a ON a.id = d.id AND a.decision = 'opens'),
decided AS (SELECT o.*, t.target_id, t.target_version, t.target_at,
              recommended_action = 'rollback' AND confidence >= 0.80 AS wanted
            FROM opened o LEFT JOIN targets t USING (model_name)),
acted AS (SELECT l.id, l.steps || CASE
    WHEN wanted AND target_id IS NULL THEN [asked, 'Step 8: there is no other version to go back to, so the incident is escalated.']
    WHEN wanted THEN [asked, 'Step 8: the version to go back to is ' || target_version || ' of ' ||
      strftime(target_at, '%Y-%m-%dT%H:%M:%S.%f') || '.', 'Step 9: resolved by going back to ' || target_version || '.']
    ELSE [asked, 'Step 8: nothing is done by itself, so the incident is escalated.'] END AS steps
  FROM (SELECT id, wanted, target_id, target_version, target_at, 'Step 7: a rollback needs confidence 0.80; asked for is ' ||
      recommended_action || ' with ' || printf('%.2f', confidence) || '.' AS asked FROM decided) JOIN logged l USING (id)),
attached AS (SELECT opened_by, count(*) FILTER (decision = 'attached') AS n FROM assigned GROUP BY opened_by)"""


@query(
    "incident_pass",
    f"""{_PASS}
SELECT d.id, d.model_id, rule_name,
  hypothesis || CASE WHEN wanted AND target_id IS NULL
    THEN ' (Rollback impossible: there is no other version to go back to)' ELSE '' END AS hypothesis,
  CASE WHEN wanted AND target_id IS NULL THEN 0.2::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN wanted AND target_id IS NULL THEN 'escalate' ELSE recommended_action END AS recommended_action,
  CASE WHEN wanted AND target_id IS NOT NULL THEN 'auto_resolved' ELSE 'escalated' END AS status,
  CASE WHEN wanted AND target_id IS NOT NULL THEN target_version END AS rollback_to,
  coalesce(a.n, 0) AS n_attached
FROM decided d LEFT JOIN attached a ON a.opened_by = d.id""",
)
def incident_pass(spark, sf_dir):
    incidents, _ = _pass(spark, sf_dir)
    return incidents.select(
        "id", "model_id", "rule_name", "hypothesis", "confidence", "recommended_action", "status", "rollback_to",
        F.coalesce("n_attached", F.lit(0)).alias("n_attached"),
    )


def _pass(spark, sf_dir):
    return I.incident_pass(
        T.alerts(spark, sf_dir), _existing(spark, sf_dir), T.deployments(spark, sf_dir),
        T.upstream_events(spark, sf_dir), T.drift_reports(spark, sf_dir), T.accuracy_reports(spark, sf_dir),
    )


@query(
    "incident_rows",
    f"""{_PASS}
SELECT 'incident-' || d.id AS id, CAST(d.id AS VARCHAR) AS alert_id, d.model_id,
  CASE WHEN wanted AND target_id IS NOT NULL THEN 'auto_resolved' ELSE 'escalated' END AS status,
  {stamp_sql("CASE WHEN wanted AND target_id IS NOT NULL THEN TIMESTAMP '2024-01-31' END")} AS resolved_at,
  CAST(n_reports AS VARCHAR) AS n_reports, rule_name, CAST(NULL AS VARCHAR) AS llm_explanation FROM decided d""",
)
def incident_rows(spark, sf_dir):
    """Stored incidents; of the evidence document two fields are read back."""
    opened, _ = _pass(spark, sf_dir)
    rows = I.incident_rows(opened, T.EVENTS_AS_OF)
    return rows.select(
        "id", "alert_id", "model_id", "status", stamp("resolved_at").alias("resolved_at"),
        F.get_json_object("evidence", "$.n_reports").alias("n_reports"),
        F.get_json_object("evidence", "$.rule_name").alias("rule_name"), "llm_explanation",
    )


@query(
    "remediation_log",
    f"""{_PASS}
SELECT id, array_to_string(steps, ' | ') AS reasoning FROM acted""",
)
def remediation_log(spark, sf_dir):
    """All steps of the incidents that the pass opens, to what was done in the end."""
    opened, _ = _pass(spark, sf_dir)
    return opened.select("id", F.array_join("reasoning_log", " | ").alias("reasoning"))


_INCIDENT_ITEMS = """
near_deploys AS (SELECT d.id AS of, count(*) AS n, arg_max(x, (x.deployed_at, x.id)) AS newest FROM decided d JOIN deploys x
  ON x.model_id = d.model_id AND x.deployed_at BETWEEN d.triggered_at - INTERVAL 30 MINUTE AND d.triggered_at + INTERVAL 5 MINUTE GROUP BY d.id),
near_events AS (SELECT d.id AS of, count(*) AS n, arg_max(x, (x.started_at, x.id)) AS newest, sum(hash_of) AS listed FROM decided d
  JOIN (SELECT *, id AS hash_of FROM upstream) x ON x.started_at <= d.triggered_at + INTERVAL 5 MINUTE
  AND (x.ended_at IS NULL OR x.ended_at >= d.triggered_at - INTERVAL 30 MINUTE) GROUP BY d.id)"""


@query(
    "incident_evidence_documents",
    f"""{_PASS},{_INCIDENT_ITEMS}
SELECT CAST(d.id AS VARCHAR) AS alert_id, alert_type, coalesce(p.n, 0)::INT AS n_deployments, p.newest.version AS version,
  p.newest.git_commit AS git_commit, CAST(p.newest.is_current AS VARCHAR) AS is_current, coalesce(e.n, 0)::INT AS n_upstream,
  e.newest.event_type AS event_type, strftime(e.newest.ended_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS ended_at, e.newest.feature AS feature,
  coalesce(e.listed, 0)::BIGINT AS listed, CAST(n_reports AS VARCHAR) AS n_reports, CAST(k AS VARCHAR) AS drifting_count,
  strftime(r.window_end, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS window_end, len(a.steps)::INT AS n_steps, a.steps[-1] AS last_step
FROM decided d LEFT JOIN near_deploys p ON p.of = d.id LEFT JOIN near_events e ON e.of = d.id JOIN acted a ON a.id = d.id""",
)
def incident_evidence_documents(spark, sf_dir):
    """What the evidence documents of new incidents hold, read back field by field."""
    upstream = T.upstream_events(spark, sf_dir).withColumn("parameters", F.to_json(F.struct("feature")))
    opened, _ = I.incident_pass(
        T.alerts(spark, sf_dir), _existing(spark, sf_dir), T.deployments(spark, sf_dir), upstream,
        T.drift_reports(spark, sf_dir), T.accuracy_reports(spark, sf_dir),
    )

    def at(path: str):
        return F.get_json_object("evidence", f"$.{path}")

    events = F.from_json(at("active_injections"), "array<struct<id:bigint,parameters:string>>")
    steps = F.from_json(at("reasoning_log"), "array<string>")
    return I.incident_rows(opened, T.EVENTS_AS_OF).select(
        "alert_id", at("alert.alert_type").alias("alert_type"), F.json_array_length(at("recent_deployments")).alias("n_deployments"),
        at("recent_deployments[0].version").alias("version"), at("recent_deployments[0].git_commit").alias("git_commit"),
        at("recent_deployments[0].is_current").alias("is_current"), F.json_array_length(at("active_injections")).alias("n_upstream"),
        at("active_injections[0].event_type").alias("event_type"), at("active_injections[0].ended_at").alias("ended_at"),
        F.get_json_object(F.get(events, F.lit(0))["parameters"], "$.feature").alias("feature"),
        F.aggregate(events, F.lit(0).cast("bigint"), lambda total, e: total + e["id"]).alias("listed"),
        at("drift_context.total_reports_evaluated").alias("n_reports"), at("drift_context.drifting_count").alias("drifting_count"),
        at("accuracy_context.window_end").alias("window_end"), F.size(steps).alias("n_steps"), F.element_at(steps, -1).alias("last_step"),
    )


@query(
    "latest_accuracy_as_of",
    f"""SELECT a.id, {stamp_sql("r.created_at")} AS created_at, r.f1 AS f1, r.n_samples AS n_samples
FROM alerts a LEFT JOIN (
  SELECT x.id AS of, arg_max(y, (y.created_at, y.id)) AS r FROM alerts x JOIN accuracies y
  ON y.model_id = x.model_id AND y.created_at <= x.triggered_at GROUP BY x.id) ON of = a.id""",
)
def latest_accuracy_as_of(spark, sf_dir):
    """The accuracy that was known when an alert was triggered, however old."""
    found = latest_before(
        T.alerts(spark, sf_dir), T.accuracy_reports(spark, sf_dir), ["model_id"], "triggered_at", "created_at", "id",
        F.struct("created_at", "f1", "n_samples"), "accuracy",
    )
    return found.select("id", stamp("accuracy.created_at").alias("created_at"), "accuracy.f1", "accuracy.n_samples")


@query(
    "newest_incident_as_of",
    """SELECT a.id, CASE WHEN created_at >= a.triggered_at - INTERVAL 15 MINUTE THEN i.incident END AS incident_id
FROM alerts a LEFT JOIN (
  SELECT x.id AS of, max(y.created_at) AS created_at, arg_max(y.id, (y.created_at, y.id)) AS incident FROM alerts x JOIN incidents y
  ON y.model_id = x.model_id AND y.created_at <= x.triggered_at GROUP BY x.id) i ON of = a.id""",
)
def newest_incident_as_of(spark, sf_dir):
    """The incident an alert would have joined when it came, for all alerts of the past."""
    alerts = T.alerts(spark, sf_dir)
    return I.incidents_as_of(alerts, T.incidents(spark, sf_dir)).select("id", "incident_id")


@query(
    "incident_pass_on_stored_tables",
    f"""{_PASS}
SELECT 'incident-' || d.id AS id, d.model_id, rule_name, confidence FROM decided d""",
)
def incident_pass_on_stored_tables(spark, sf_dir):
    """The pass over tables that were appended and read back: text ids, parameters as JSON."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    upstream = T.upstream_events(spark, sf_dir)
    derived = {
        "alerts": T.alerts(spark, sf_dir).withColumn("details", F.lit("{}")),
        "incidents": _existing(spark, sf_dir), "deployments": T.deployments(spark, sf_dir),
        "upstream_events": upstream.withColumn("parameters", F.to_json(F.struct("feature"))),
        "drift_reports": T.drift_reports(spark, sf_dir), "accuracy_reports": T.accuracy_reports(spark, sf_dir),
    }
    stored = {}
    for name, rows in derived.items():
        files.store_derived(rows, root, name)
        stored[name] = files.read_table(spark, root, name).drop("model_name", "dt")
    opened, _ = I.incident_pass(
        stored["alerts"], stored["incidents"], stored["deployments"], stored["upstream_events"], stored["drift_reports"],
        stored["accuracy_reports"],
    )
    number = F.regexp_replace(F.regexp_replace("id", "^incident-0*", ""), "^$", "0")
    return I.incident_rows(opened, T.EVENTS_AS_OF).select(
        F.concat(F.lit("incident-"), number).alias("id"), "model_id",
        F.get_json_object("evidence", "$.rule_name").alias("rule_name"), "confidence",
    )


@query(
    "attached_alerts",
    f"""WITH {_OLD}
SELECT coalesce(CAST(incident_id AS VARCHAR), 'incident-' || opened_by) AS incident_id, CAST(id AS VARCHAR) AS alert_id FROM assigned""",
)
def attached_alerts(spark, sf_dir):
    return I.attached_alerts(I.assign_alerts(T.alerts(spark, sf_dir), _existing(spark, sf_dir)))


@query(
    "alerts_after_pass",
    f"""WITH {_OLD}
SELECT a.id, a.model_id, a.processed OR s.id IS NOT NULL AS processed FROM alerts a LEFT JOIN assigned s USING (id)""",
)
def alerts_after_pass(spark, sf_dir):
    alerts = T.alerts(spark, sf_dir)
    handled = I.alerts_after_pass(alerts, I.assign_alerts(alerts, _existing(spark, sf_dir)))
    return handled.select("id", "model_id", "processed")


@query(
    "remediation_decisions",
    f"""
WITH {_EVIDENCE},{_TARGETS}
SELECT d.id, d.model_id, recommended_action,
  CASE WHEN recommended_action = 'rollback' AND confidence >= 0.80 AND target_id IS NOT NULL THEN 'auto_resolved'
       ELSE 'escalated' END AS status,
  CASE WHEN recommended_action = 'rollback' AND confidence >= 0.80 THEN target_version END AS rollback_to
FROM diagnosed d LEFT JOIN targets t ON t.model_name = split_part(d.model_id, ':', 1)""",
)
def remediation_decisions(spark, sf_dir):
    decided = I.remediate(I.diagnose(_evidence(spark, sf_dir)), I.rollback_targets(T.deployments(spark, sf_dir)))
    return decided.select("id", "model_id", "recommended_action", "status", "rollback_to")


_ITEMS = """
items AS (SELECT a.id AS alert_id, 'deployment' AS kind, d.id AS item_id, d.deployed_at AS item_at, d.version AS label,
                 CAST(NULL AS VARCHAR) AS feature
          FROM alerts a JOIN deploys d ON a.model_id = d.model_id
           AND d.deployed_at BETWEEN a.triggered_at - INTERVAL 30 MINUTE AND a.triggered_at + INTERVAL 5 MINUTE
          UNION ALL
          SELECT a.id, 'upstream', u.id, u.started_at, u.event_type, u.feature
          FROM alerts a JOIN upstream u ON u.started_at <= a.triggered_at + INTERVAL 5 MINUTE
           AND (u.ended_at IS NULL OR u.ended_at >= a.triggered_at - INTERVAL 30 MINUTE))"""
@query(
    "evidence_items",
    f"""WITH {_ITEMS}
SELECT alert_id, kind, item_id, {stamp_sql("item_at")} AS item_at, label, feature FROM items""",
)
def evidence_items(spark, sf_dir):
    items = I.evidence_items(T.alerts(spark, sf_dir), T.deployments(spark, sf_dir), T.upstream_events(spark, sf_dir))
    return items.select("alert_id", "kind", "item_id", stamp("item_at").alias("item_at"), "label", "feature")


@query(
    "evidence_items_shortened",
    f"""WITH {_ITEMS}
SELECT alert_id, kind, item_id, CASE WHEN length(label) > 8 THEN substring(label, 1, 8) || '… (truncated)' ELSE label END
       AS label FROM items
QUALIFY row_number() OVER (PARTITION BY alert_id, kind ORDER BY item_at DESC, item_id DESC) <= 5""",
)
def evidence_items_shortened(spark, sf_dir):
    items = I.evidence_items(T.alerts(spark, sf_dir), T.deployments(spark, sf_dir), T.upstream_events(spark, sf_dir))
    return I.shorten_items(items, width=8).select("alert_id", "kind", "item_id", "label")


@query(
    "pending_alerts",
    f"""SELECT id, model_id, alert_type, {stamp_sql("triggered_at")} AS triggered_at FROM alerts WHERE NOT processed""",
)
def pending_alerts(spark, sf_dir):
    rows = I.pending_alerts(T.alerts(spark, sf_dir))
    return rows.select("id", "model_id", "alert_type", stamp("triggered_at").alias("triggered_at"))
