"""The telemetry views as SQL, for the checks."""

from __future__ import annotations

import re

VIEWS = {
    "feat": """
        SELECT 'm' || (l_suppkey % 4) || ':v1' AS model_id, l_orderkey AS row_id, l_shipdate AS created_at,
               l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax,
               nullif(l_tax, 0.0) AS paid_tax, l_returnflag AS returnflag, l_linestatus AS linestatus,
               l_shipdate >= TIMESTAMP '1998-01-01' AS is_current
        FROM lineitem""",
    "feat_numeric": """
        SELECT model_id, is_current, 'quantity' AS feature, quantity AS v FROM feat
        UNION ALL SELECT model_id, is_current, 'extendedprice', extendedprice FROM feat
        UNION ALL SELECT model_id, is_current, 'discount', discount FROM feat
        UNION ALL SELECT model_id, is_current, 'tax', tax FROM feat""",
    "feat_category": """
        SELECT model_id, is_current, 'returnflag' AS feature, returnflag AS v FROM feat
        UNION ALL SELECT model_id, is_current, 'linestatus', linestatus FROM feat""",
    "preds": """
        SELECT o_orderkey AS id, 'm' || (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) || ':v1' AS model_id,
               o_totalprice AS price, nullif(o_custkey % 100, 0) AS segment, o_orderstatus AS status,
               o_totalprice / 500000.0::DOUBLE AS confidence, o_totalprice / 500000.0::DOUBLE >= 0.5 AS prediction,
               o_orderdate AS created_at, o_orderdate >= TIMESTAMP '2000-01-01' AS is_current
        FROM orders""",
    "preds_numeric": """
        SELECT model_id, is_current, 'price' AS feature, price AS v FROM preds
        UNION ALL SELECT model_id, is_current, 'segment', CAST(segment AS DOUBLE) FROM preds
        UNION ALL SELECT model_id, is_current, '_prediction', confidence FROM preds""",
    "preds_category": """
        SELECT model_id, is_current, 'status' AS feature, status AS v FROM preds""",
    "outs": """
        SELECT l_orderkey AS prediction_id, bool_or(l_returnflag = 'R') AS true_label,
               max(l_shipdate) AS observed_at, 300.0::DOUBLE AS delay_seconds
        FROM lineitem GROUP BY l_orderkey""",
    "doc_preds": """
        SELECT doc_id AS id, lang || ':v1' AS model_id, n_chars >= 1000 AS prediction,
               n_chars::DOUBLE / (n_chars::DOUBLE + 1000.0::DOUBLE) AS confidence FROM documents""",
    "doc_outs": "SELECT doc_id AS prediction_id, quality = 1 AS true_label FROM labels",
    "alerts": """
        SELECT event_id AS id, 'm' || (user_id % 5) || ':v1' AS model_id,
               CASE WHEN event_id % 3 = 0 THEN 'accuracy_drop' ELSE 'feature_drift' END AS alert_type,
               CASE WHEN value > 50 THEN 'critical' ELSE 'warning' END AS severity,
               ts AS triggered_at, event_id % 4 = 0 AS processed
        FROM events WHERE event_type = 'error'""",
    "deploy_rows": """
        SELECT event_id AS id, 'm' || (user_id % 5) || ':v1' AS model_id, 'v' || (event_id % 9 + 1) AS version,
               ts AS deployed_at,
               CASE event_id % 4 WHEN 0 THEN 'deployed' WHEN 1 THEN 'canary' WHEN 2 THEN 'rejected'
                    ELSE 'canary_failed' END AS status,
               CAST(event_id % 5 * 25 AS DOUBLE) AS traffic_percentage,
               CASE WHEN event_id % 4 = 2 THEN 'below the gate' END AS rejection_reason,
               CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 HOUR END AS promoted_at,
               substr(md5(event_id::VARCHAR), 1, 7) AS git_commit
        FROM events WHERE event_type = 'signup' AND value > 80""",
    "deploys": """
        SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY deployed_at DESC, id DESC) = 1 AS is_current
        FROM deploy_rows""",
    "upstream": """
        SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'drift_numeric' ELSE 'corrupt_feature' END AS event_type,
               'f' || (event_id % 6) AS feature, ts AS started_at,
               CASE WHEN ts < TIMESTAMP '2024-01-30' THEN ts + INTERVAL 10 MINUTE END AS ended_at
        FROM events WHERE event_type = 'purchase' AND value > 150""",
    "drifts": """
        SELECT event_id AS id, 'm' || (user_id % 5) || ':v1' AS model_id,
               CASE WHEN k % 6 = 5 THEN '_prediction' ELSE 'f' || (k % 6) END AS feature_name,
               ts AS checked_at, value / 2000.0::DOUBLE AS psi_score, CAST(1000 AS BIGINT) AS sample_size,
               CASE WHEN value / 2000.0::DOUBLE < 0.10 THEN 'stable' WHEN value / 2000.0::DOUBLE < 0.25 THEN 'moderate'
                    ELSE 'significant' END AS status
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view')""",
    "accuracies": """
        SELECT event_id AS id, 'm' || (user_id % 5) || ':v1' AS model_id, ts - INTERVAL 1 DAY AS window_start,
               ts AS window_end, CASE WHEN event_id % 5 <> 0 THEN round(value / 500.0::DOUBLE, 4) END AS f1,
               CASE WHEN event_id % 7 <> 0 THEN round(value / 700.0::DOUBLE, 4) END AS "precision",
               round(value / 900.0::DOUBLE, 4) AS recall, round(value / 1100.0::DOUBLE, 4) AS roc_auc,
               event_id % 1000 AS n_samples, ts AS created_at
        FROM events WHERE event_type = 'click' AND value > 150""",
    "incidents": """
        SELECT event_id AS id, event_id AS alert_id, 'm' || (user_id % 5) || ':v1' AS model_id,
               'Unclear root cause' AS hypothesis, value / 500.0::DOUBLE AS confidence,
               CASE WHEN event_id % 2 = 0 THEN 'escalated' ELSE 'auto_resolved' END AS status,
               CASE WHEN event_id % 2 = 0 THEN 'escalate' ELSE 'rollback' END AS recommended_action,
               CAST(NULL AS VARCHAR) AS llm_explanation, ts AS created_at
        FROM events WHERE event_type = 'error' AND value > 200""",
    "token_calls": """
        SELECT 'explainer-' || (conv_id % 3) AS model_name,
               CAST(CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS BIGINT) AS tokens_in,
               CAST(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END AS BIGINT) AS tokens_out,
               TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INT)) AS called_at
        FROM conversations""",
}


def _used(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def with_views(sql: str) -> str:
    """Put the views a statement mentions in front of it, in dependency order."""
    needed: set[str] = set()
    pending = _used(sql)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending += _used(VIEWS[name])
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
