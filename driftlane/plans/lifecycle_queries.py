"""Data quality, splits, gates, canaries and what-if scenarios over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.operators import canary, drift, modeling, profile, quality, scenario, splits, tenants
from driftlane.operators.accuracy import classification_metrics, labelled
from driftlane.operators.longform import feature_rows
from driftlane.operators.scenario import Perturbation
from driftlane.plans.drift_queries import _decile_edges, _psi_sql
from driftlane.plans.model_queries import ORDERS, training_rows
from driftlane.plans.registry import query
from driftlane.plans.report_queries import metrics_sql
from driftlane.session import materialise, shared_folder
from driftlane.sources import driver_tables as T
from driftlane.sources import files

# --- cleaning ----------------------------------------------------------------------

_RAW_LABELS = ("Yes", " no ", "TRUE", "0", "maybe")


@query(
    "lenient_cast_and_labels",
    """
SELECT o_orderkey AS id, TRY_CAST(t AS DOUBLE) AS charges, coalesce(TRY_CAST(t AS DOUBLE), 0.0::DOUBLE) AS charges_or_zero,
       CAST(CASE WHEN lower(trim(l)) IN ('yes', 'true', '1') THEN 1 ELSE 0 END AS INT) AS label,
       CASE WHEN o_totalprice > 250000 THEN 'Churn' ELSE 'No Churn' END AS prediction_label
FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 11 = 0 THEN 'n/a'
                     ELSE CAST(o_custkey AS VARCHAR) END AS t,
             ['Yes', ' no ', 'TRUE', '0', 'maybe'][o_orderkey % 5 + 1] AS l FROM orders)""",
)
def lenient_cast_and_labels(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 7 == 0, " ").when(key % 11 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    raw = F.element_at(F.array(*[F.lit(v) for v in _RAW_LABELS]), (key % 5 + 1).cast("int"))
    return T.table(spark, sf_dir, "orders").select(
        key.alias("id"), quality.lenient_number(text).alias("charges"),
        quality.number_or_zero(text).alias("charges_or_zero"), quality.binary_label(raw).alias("label"),
        quality.prediction_label(F.col("o_totalprice") > 250_000, C.CHURN).alias("prediction_label"),
    )


# --- validation: requests with some broken fields, made from the orders ---------------


def _request_columns(tenant: C.Tenant):
    """The feature columns of a request; some are missing, no number, negative or unknown."""
    key, customer, out = F.col("o_orderkey"), F.col("o_custkey"), []
    for i, name in enumerate(tenant.numeric):
        number = customer * (i + 3) % 73
        if name == "TotalCharges":
            # Tenure times monthly charge, and twice as much for every tenth.
            number = (customer * 3 % 73) * (customer * 4 % 73) * F.when(key % 10 == 0, 2).otherwise(1)
        shifted = key + i * 7
        out.append(
            F.when(shifted % 83 == 0, None).when(shifted % 89 == 0, "abc").when(shifted % 97 == 0, "-1")
            .otherwise(number.cast("string")).alias(name)
        )
    for i, name in enumerate(tenant.categorical):
        domain, shifted = tenant.domains[name], key + i * 13
        value = F.element_at(F.array(*[F.lit(d) for d in domain]), ((key + i) % len(domain) + 1).cast("int"))
        out.append(F.when(shifted % 331 == 0, None).when(shifted % 337 == 0, "bogus").otherwise(value).alias(name))
    return out


def _request_sql(tenant: C.Tenant) -> str:
    out = []
    for i, name in enumerate(tenant.numeric):
        number = f"(o_custkey * {i + 3}) % 73"
        if name == "TotalCharges":
            number = "((o_custkey * 3) % 73) * ((o_custkey * 4) % 73) * CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END"
        key = f"(o_orderkey + {i * 7})"
        out.append(
            f"""CASE WHEN {key} % 83 = 0 THEN NULL WHEN {key} % 89 = 0 THEN 'abc' WHEN {key} % 97 = 0 THEN '-1'
                ELSE CAST({number} AS VARCHAR) END AS "{name}\""""
        )
    for i, name in enumerate(tenant.categorical):
        domain, key = tenant.domains[name], f"(o_orderkey + {i * 13})"
        listed = ", ".join(f"'{d}'" for d in domain)
        out.append(
            f"""CASE WHEN {key} % 331 = 0 THEN NULL WHEN {key} % 337 = 0 THEN 'bogus'
                ELSE [{listed}][(o_orderkey + {i}) % {len(domain)} + 1] END AS "{name}\""""
        )
    return ", ".join(out)


def _violations_sql(tenant: C.Tenant) -> str:
    checks = [
        f"""CASE WHEN "{n}" IS NULL THEN 'missing:{n}' WHEN TRY_CAST("{n}" AS DOUBLE) IS NULL THEN 'not_a_number:{n}'
            WHEN TRY_CAST("{n}" AS DOUBLE) < 0 THEN 'negative:{n}' END"""
        for n in tenant.numeric
    ] + [
        f"""CASE WHEN "{n}" IS NULL THEN 'missing:{n}' WHEN "{n}" NOT IN ({", ".join(f"'{d}'" for d in tenant.domains[n])})
            THEN 'domain:{n}' END"""
        for n in tenant.categorical
    ]
    across = "v"
    if "TotalCharges" in tenant.numeric:
        across = """CASE WHEN len(v) = 0 AND CAST(tenure AS DOUBLE) > 0 AND CAST("TotalCharges" AS DOUBLE) >
            CAST(tenure AS DOUBLE) * CAST("MonthlyCharges" AS DOUBLE) * 1.10::DOUBLE + 1
            THEN ['implausible:TotalCharges'] ELSE v END"""
    return f"""requests AS (SELECT o_orderkey AS id, o_orderstatus AS source, {_request_sql(tenant)} FROM orders),
checked AS (SELECT *, list_filter([{", ".join(checks)}], lambda x: x IS NOT NULL) AS v FROM requests),
validated AS (SELECT id, source, {across} AS violations FROM checked)"""


def _validated(spark, sf_dir, tenant):
    # Written out first, so that requests are stored columns as they would be in production.
    requests = materialise(
        T.table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), *_request_columns(tenant)
        )
    )
    return quality.validate(requests, tenant)


def _quarantine(tenant):
    def run(spark, sf_dir):
        _, rejected = quality.split_valid(_validated(spark, sf_dir, tenant))
        return rejected.select("id", F.array_join("violations", ",").alias("violations"))

    return run


for _tenant, _name in ((C.CHURN, "churn"), (C.FRAUD, "fraud")):
    query(
        f"quarantined_{_name}_requests",
        f"""WITH {_violations_sql(_tenant)}
SELECT id, array_to_string(violations, ',') AS violations FROM validated WHERE len(violations) > 0""",
    )(_quarantine(_tenant))


@query(
    "validity_counts",
    f"""WITH {_violations_sql(C.CHURN)}
SELECT source, count(*) AS n_sent, count(*) FILTER (len(violations) = 0) AS n_ok,
       count(*) FILTER (len(violations) > 0) AS n_rejected FROM validated GROUP BY source""",
)
def validity_counts(spark, sf_dir):
    return quality.validity_counts(_validated(spark, sf_dir, C.CHURN), ["source"])


@query(
    "violation_counts",
    f"""WITH {_violations_sql(C.CHURN)}
SELECT source, reason, count(*) AS n FROM (SELECT source, unnest(violations) AS reason FROM validated) GROUP BY ALL""",
)
def violation_counts(spark, sf_dir):
    return quality.violation_counts(_validated(spark, sf_dir, C.CHURN), ["source"])


@query(
    "preprocessed_requests",
    f"""WITH requests AS (SELECT o_orderkey, {_request_sql(C.FRAUD)} FROM orders)
SELECT {", ".join(f'TRY_CAST("{c}" AS DOUBLE) AS "{c}"' for c in C.FRAUD.numeric)},
  {", ".join(f'"{c}"' for c in C.FRAUD.categorical)}, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS INT) AS is_fraud FROM requests""",
)
def preprocessed_requests(spark, sf_dir):
    """Features in declared order and the label; ids and other columns are gone."""
    raw = _raw(spark, sf_dir, C.FRAUD).withColumn("note", F.lit("not a feature"))
    return quality.preprocess(raw, C.FRAUD)


# --- from a raw file to stored baselines ---------------------------------------------


def _raw(spark, sf_dir, tenant):
    """A tenant's raw rows: text ids, features as sent, labels as people write them."""
    key = F.col("o_orderkey")
    fraud = F.when(key % 6 == 0, "1").otherwise("0")
    churn = F.element_at(F.array(*[F.lit(v) for v in _RAW_LABELS]), (key % 5 + 1).cast("int"))
    return T.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("id-"), F.lpad(key.cast("string"), 12, "0")).alias(tenant.id_column), *_request_columns(tenant),
        (churn if tenant is C.CHURN else fraud).alias(tenant.target),
    )


def _trained_sql(tenant: C.Tenant, positive: str) -> str:
    name = tenant.name.split("-")[0]
    values = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, TRY_CAST("{c}" AS DOUBLE) AS v FROM {name}_train""" for c in tenant.numeric
    )
    return f"""{name}_raw AS (SELECT 'id-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, {_request_sql(tenant)},
  CASE WHEN {positive} THEN 1 ELSE 0 END AS label FROM orders),
{name}_kept AS (SELECT * FROM {name}_raw QUALIFY row_number() OVER (ORDER BY id) <= floor(0.85::DOUBLE * count(*) OVER ())),
{name}_train AS (SELECT * FROM {name}_kept QUALIFY
  row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(id), 1, 12) AS BIGINT)) >
  floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5::DOUBLE)),
{name}_profile AS (SELECT '{tenant.name}:v2' AS model_id, feature, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
  round(median(v), 4) AS median, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.9), 4) AS d9,
  count(*) FILTER (v IS NULL) AS n_missing FROM ({values}) GROUP BY feature)"""


@query(
    "raw_files_to_stored_baselines",
    f"""WITH {_trained_sql(C.CHURN, "o_orderkey % 5 IN (0, 2)")},
{_trained_sql(C.FRAUD, "o_orderkey % 6 = 0")}
SELECT * FROM churn_profile UNION ALL SELECT * FROM fraud_profile""",
)
def raw_files_to_stored_baselines(spark, sf_dir):
    """Both tenants: raw CSV, cleaning, hold-out, split, training, stored baselines; the newest version is loaded."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for tenant in (C.CHURN, C.FRAUD):
        path = f"{root}/{tenant.name}"
        _raw(spark, sf_dir, tenant).write.option("header", True).csv(path)
        trained = modeling.train_from_csv(spark, path, tenant, "v2", f"{root}/store")
        files.save_baseline(f"{root}/store", numeric=trained.numeric.withColumns({"model_id": F.lit(f"{tenant.name}:v1"), "mean": F.lit(0.0)}))
    return files.load_newest(spark, f"{root}/store", "numeric").select(
        "model_id", "feature", "mean", "std", "median", "p25", F.col("deciles")[8].alias("d9"), "n_missing"
    )


@query(
    "fit_all_tenants",
    """SELECT model_name, CAST(place AS INT) AS place, 0.0::DOUBLE AS gradient
FROM (VALUES ('churn-model', 20), ('fraud-model', 9), ('order-model', 5)) m(model_name, size), range(0, 20) r(place) WHERE place < size""",
)
def fit_all_tenants(spark, sf_dir):
    """Three tenants fitted in one pass per step; each model's gradient vanishes at its fit."""
    raw = [(t, quality.training_rows(_raw(spark, sf_dir, t), t)) for t in (C.CHURN, C.FRAUD)]
    parts = [tenants.prepared_rows(materialise(rows), t) for t, rows in (*raw, (ORDERS, training_rows(spark, sf_dir)))]
    prepared = materialise(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    found = tenants.gradients(prepared, tenants.fit_tenants(prepared))
    return found.select("model_name", "place", F.abs(F.round("gradient", 6)).alias("gradient"))


# --- splits ---------------------------------------------------------------------------


@query(
    "ordered_holdout_split",
    """
SELECT c_name AS id, row_number() OVER (ORDER BY c_name) > floor(0.85::DOUBLE * (SELECT count(*) FROM customer)) AS held_out
FROM customer""",
)
def ordered_holdout_split(spark, sf_dir):
    customers = T.table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"))
    return splits.ordered_holdout(customers, "id")


@query(
    "ordered_holdout_large_ids",
    """
SELECT o_orderkey + 1152921504606846976 AS id,
       row_number() OVER (ORDER BY o_orderkey) > floor(0.85::DOUBLE * (SELECT count(*) FROM orders)) AS held_out
FROM orders""",
)
def ordered_holdout_large_ids(spark, sf_dir):
    """Whole numbers that a double can't tell apart."""
    ids = T.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + F.lit(2**60)).alias("id"))
    return splits.ordered_holdout(ids, "id")


_SPLIT = """
hashed AS (SELECT o_orderkey AS id, split_part(o_orderpriority, '-', 1) AS tenant,
                  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS label,
                  CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM orders),
split AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) <=
                    floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test FROM hashed)"""


def _split(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("tenant"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )
    return splits.stratified_split(rows, "label", "id")


@query("stratified_split", f"WITH {_SPLIT}\nSELECT id, label, is_test FROM split")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "label", "is_test")


@query(
    "class_distribution",
    f"""WITH {_SPLIT}
SELECT tenant, count(*) AS n, count(*) FILTER (label = 1) AS n_positive, round(avg(label), 6) AS positive_rate
FROM hashed GROUP BY tenant""",
)
def class_distribution(spark, sf_dir):
    rows = T.table(spark, sf_dir, "orders").select(
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("tenant"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )
    return splits.class_distribution(rows, ["tenant"], "label").withColumn("positive_rate", F.round("positive_rate", 6))


@query(
    "majority_class_baseline",
    f"""WITH {_SPLIT},
counts AS (SELECT tenant, label, count(*) FILTER (NOT is_test) AS train, count(*) FILTER (is_test) AS test
           FROM split GROUP BY ALL)
SELECT tenant, CAST(arg_max(label, (train, -label)) AS INT) AS majority_class, CAST(sum(test) AS BIGINT) AS n_test,
       round(arg_max(test, (train, -label))::DOUBLE / sum(test), 6) AS accuracy FROM counts GROUP BY tenant""",
)
def majority_class_baseline(spark, sf_dir):
    return splits.majority_baseline(_split(spark, sf_dir), ["tenant"], "label").withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query(
    "next_versions",
    """
SELECT model_id, 'v' || (max(CAST(regexp_extract(version, '(\\d+)', 1) AS INT)) + 1) AS next_version
FROM deploys GROUP BY model_id""",
)
def next_versions(spark, sf_dir):
    return splits.next_version(T.deployments(spark, sf_dir))


# --- gate and canary -------------------------------------------------------------------


@query(
    "metric_gate",
    metrics_sql(
        """SELECT p.model_id || '/' || r.rule AS model_id, CASE WHEN r.rule = 'new' THEN p.price > 100000
             ELSE p.prediction END AS prediction, p.confidence, o.true_label
           FROM preds p JOIN outs o ON p.id = o.prediction_id CROSS JOIN (VALUES ('new'), ('old')) r(rule)""",
        "model_id",
        """,f1s AS (SELECT split_part(model_id, ':', 1) AS model_name, split_part(model_id, '/', 2) AS rule,
                     round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS f1 FROM metrics),
        gate AS (SELECT a.model_name, a.f1 AS candidate_f1, b.f1 + CASE WHEN a.model_name < 'm2' THEN 0.3 ELSE 0 END::DOUBLE
                   AS baseline_f1 FROM f1s a JOIN f1s b USING (model_name) WHERE a.rule = 'new' AND b.rule = 'old')
        SELECT model_name || ':v2' AS model_id, candidate_f1, baseline_f1, candidate_f1 >= baseline_f1 + 0.01::DOUBLE
                 AS gate_passed,
               CASE WHEN candidate_f1 >= baseline_f1 + 0.01::DOUBLE THEN 'canary' ELSE 'rejected' END AS status,
               CASE WHEN candidate_f1 >= baseline_f1 + 0.01::DOUBLE THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END
                 AS traffic_percentage,
               CASE WHEN NOT candidate_f1 >= baseline_f1 + 0.01::DOUBLE THEN
                 printf('F1 of %.4f is below %.4f, which is the serving model''s %.4f plus 0.0100.',
                        candidate_f1, baseline_f1 + 0.01::DOUBLE, baseline_f1) END AS rejection_reason FROM gate""",
    ),
)
def metric_gate(spark, sf_dir):
    price = F.get_json_object("input_features", "$.price").cast("double")
    joined = labelled(T.predictions(spark, sf_dir), T.outcomes(spark, sf_dir)).withColumn(
        "model_name", F.split_part("model_id", F.lit(":"), F.lit(1))
    )
    both = joined.select(
        "model_name", "confidence", "true_label",
        F.explode(
            F.array(
                F.struct(F.lit("new").alias("rule"), (price > 100_000).alias("prediction")),
                F.struct(F.lit("old").alias("rule"), F.col("prediction")),
            )
        ).alias("_r"),
    ).select("model_name", "confidence", "true_label", "_r.*")
    metrics = classification_metrics(both, ["model_name", "rule"]).withColumn("f1", F.round("f1", 4))
    candidates = metrics.filter("rule = 'new'").select("model_name", F.lit("v2").alias("version"), "f1")
    raised = F.when(F.col("model_name") < "m2", 0.3).otherwise(0.0)
    baselines = metrics.filter("rule = 'old'").select("model_name", (F.col("f1") + raised).alias("f1"))
    return canary.metric_gate(candidates, baselines, T.PREDICTIONS_AS_OF).select(
        "model_id", "candidate_f1", "baseline_f1", "gate_passed", "status", "traffic_percentage", "rejection_reason"
    )


@query(
    "canary_traffic_split",
    """
SELECT o_orderpriority AS tenant, count(*) AS n_requests,
       count(*) FILTER ((o_orderkey * 2654435761) % 10000 < 1000) AS n_canary FROM orders GROUP BY o_orderpriority""",
)
def canary_traffic_split(spark, sf_dir):
    routed = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("tenant"),
        canary.to_canary(F.col("o_orderkey"), C.CANARY_SHARE_PERCENT).alias("c"),
    )
    return routed.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if("c").alias("n_canary"))


@query(
    "canary_split_large_ids",
    """
SELECT o_orderpriority AS tenant,
       count(*) FILTER (((o_orderkey + 1152921504606846976)::HUGEINT * 2654435761) % 10000 < 1000) AS n_canary,
       count(*) FILTER ((CAST('0x' || substr(md5('r' || o_orderkey), 1, 12) AS HUGEINT) * 2654435761) % 10000 < 1000)
         AS n_canary_by_text
FROM orders GROUP BY o_orderpriority""",
)
def canary_split_large_ids(spark, sf_dir):
    """Ids whose product has no room in a long, and ids that are text."""
    key = F.col("o_orderkey")
    routed = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("tenant"),
        canary.to_canary(key + F.lit(2**60), C.CANARY_SHARE_PERCENT).alias("by_number"),
        canary.to_canary(F.concat(F.lit("r"), key), C.CANARY_SHARE_PERCENT).alias("by_text"),
    )
    return routed.groupBy("tenant").agg(
        F.count_if("by_number").alias("n_canary"), F.count_if("by_text").alias("n_canary_by_text")
    )


# One canary per user: clicks, views and purchases are its predictions, dear errors its alerts.
_CANARY = """
canaries AS (SELECT DISTINCT 'u' || user_id AS model_name FROM events),
served AS (SELECT 'u' || user_id AS model_name, count(*) AS n FROM events
           WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1),
alarmed AS (SELECT 'u' || user_id AS model_name, count(*) AS n FROM events
            WHERE event_type = 'error' AND value > 150 GROUP BY 1),
decided AS (SELECT model_name, coalesce(a.n, 0) AS alerts_count, coalesce(s.n, 0) AS predictions_count,
   CASE WHEN coalesce(a.n, 0) > 0 THEN 'canary_failed' WHEN coalesce(s.n, 0) >= 50 THEN 'promoted' ELSE 'observing' END
     AS decision FROM canaries LEFT JOIN served s USING (model_name) LEFT JOIN alarmed a USING (model_name))"""


def _canary_frames(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").withColumn("model_id", F.concat(F.lit("u"), "user_id", F.lit(":v2")))
    canaries = events.select(F.concat(F.lit("u"), "user_id").alias("model_name")).distinct().select(
        "model_name", F.lit("v2").alias("candidate_version"), F.lit("v1").alias("baseline_version")
    )
    served = events.filter(F.col("event_type").isin("click", "view", "purchase"))
    alarmed = events.filter((F.col("event_type") == "error") & (F.col("value") > 150))
    return canaries, canary.canary_decisions(canaries, alarmed, served)


@query("canary_decisions", f"WITH {_CANARY}\nSELECT model_name, alerts_count, predictions_count, decision FROM decided")
def canary_decisions(spark, sf_dir):
    return _canary_frames(spark, sf_dir)[1].select("model_name", "alerts_count", "predictions_count", "decision")


@query(
    "deployments_after_canaries",
    f"""WITH {_CANARY},
both_versions AS (SELECT model_name, 'v1' AS version, 'deployed' AS status, TRUE AS is_current, 90.0::DOUBLE AS traffic
            FROM canaries UNION ALL SELECT model_name, 'v2', 'canary', FALSE, 10.0::DOUBLE FROM canaries)
SELECT b.model_name || ':' || b.version AS model_id,
  CASE WHEN version = 'v2' AND decision = 'promoted' THEN 'deployed' WHEN version = 'v2' AND decision = 'canary_failed'
       THEN 'canary_failed' ELSE status END AS status,
  CASE WHEN version = 'v2' AND decision = 'promoted' THEN TRUE WHEN version = 'v2' AND decision = 'canary_failed' THEN FALSE
       WHEN version = 'v1' AND decision = 'promoted' THEN FALSE ELSE is_current END AS is_current,
  CASE WHEN version = 'v2' AND decision = 'promoted' THEN 100.0 WHEN version = 'v2' AND decision = 'canary_failed' THEN 0.0
       WHEN version = 'v1' AND decision = 'promoted' THEN 0.0 ELSE traffic END::DOUBLE AS traffic_percentage
FROM both_versions b JOIN decided d USING (model_name)""",
)
def deployments_after_canaries(spark, sf_dir):
    canaries, decisions = _canary_frames(spark, sf_dir)
    rows = canaries.select(
        F.explode(
            F.array(
                F.struct(F.concat("model_name", F.lit(":v1")).alias("model_id"), F.lit("deployed").alias("status"),
                         F.lit(True).alias("is_current"), F.lit(90.0).alias("traffic_percentage")),
                F.struct(F.concat("model_name", F.lit(":v2")).alias("model_id"), F.lit("canary").alias("status"),
                         F.lit(False).alias("is_current"), F.lit(10.0).alias("traffic_percentage")),
            )
        ).alias("_d")
    ).select("_d.*", F.lit(None).cast("timestamp").alias("promoted_at"))
    after = canary.next_deployments(rows, decisions, T.EVENTS_AS_OF)
    return after.select("model_id", "status", "is_current", "traffic_percentage")


# --- scenarios --------------------------------------------------------------------------

SCENARIOS = {
    "none": (),
    "shift": (Perturbation("shift", "quantity", amount=10.0),),
    "two_shifts": (Perturbation("shift", "quantity", amount=10.0), Perturbation("shift", "quantity", amount=15.0)),
    "skew": (Perturbation("skew", "returnflag", value="R"),),
    "corrupt": (Perturbation("corrupt", "discount"),),
}
_SCENARIO_NAMES = ", ".join(f"('{s}')" for s in SCENARIOS)
_TAG = "model_id || '|' || s.scenario"
_QUANTITY = "quantity + CASE s.scenario WHEN 'shift' THEN 10 WHEN 'two_shifts' THEN 25 ELSE 0 END"
_FLAG = "CASE WHEN s.scenario = 'skew' AND (row_id * 2654435761) % 10000 < 8000 THEN 'R' ELSE returnflag END"


def _scenario_rows(pairs):
    # The baseline rows stay as they are; only current rows are perturbed.
    return "(" + " UNION ALL ".join(
        f"SELECT {_TAG} AS model_id, is_current, '{name}' AS feature, "
        f"CASE WHEN is_current THEN {changed} ELSE {plain} END AS v FROM feat, (VALUES {_SCENARIO_NAMES}) s(scenario)"
        for name, changed, plain in pairs
    ) + ")"


_SCENARIO_NUMERIC = _scenario_rows([
    ("quantity", _QUANTITY, "quantity"),
    ("discount", "CASE WHEN s.scenario <> 'corrupt' THEN discount END", "discount"),
])
_SCENARIO_CATEGORY = _scenario_rows([("returnflag", _FLAG, "returnflag")])


@query(
    "scenario_response_curve",
    _psi_sql(
        _SCENARIO_NUMERIC, _SCENARIO_CATEGORY,
        f"(SELECT {_TAG} AS model_id, is_current FROM feat, (VALUES {_SCENARIO_NAMES}) s(scenario))",
        _decile_edges(_SCENARIO_NUMERIC), "1",
        """SELECT split_part(model_id, '|', 1) AS model_id, split_part(model_id, '|', 2) AS scenario, feature_name,
                  psi_score, sample_size, status FROM report""",
    ),
)
def scenario_response_curve(spark, sf_dir):
    rows = T.feature_table(spark, sf_dir).select("model_id", "row_id", "created_at", "quantity", "discount", "returnflag")
    before, current = (
        rows.filter(F.col("created_at") < F.lit(T.DRIFT_SPLIT)), rows.filter(F.col("created_at") >= F.lit(T.DRIFT_SPLIT))
    )
    baseline = feature_rows(
        before, {"quantity": F.col("quantity"), "discount": F.col("discount")}, {"returnflag": F.col("returnflag")}
    )
    edges = drift.edges_from_deciles(materialise(profile.numeric_profile(baseline)))
    expected = drift.uniform_mass(edges).unionByName(drift.category_mass(profile.category_counts(baseline)))
    return scenario.response_curve(
        current, SCENARIOS, ("quantity", "discount"), ("returnflag",), "row_id", edges, expected, T.PREDICTIONS_AS_OF
    )


_WINDOWED = (
    Perturbation("shift", "price", amount=20.0),
    Perturbation("shift", "price", amount=5.0, started_at=T.DRIFT_SPLIT, ended_at=T.PREDICTION_SPLIT),
    Perturbation("corrupt", "price", started_at=T.PREDICTION_SPLIT),
    Perturbation("skew", "status", value="O", probability=0.5, ended_at=T.DRIFT_SPLIT),
    Perturbation("delay", started_at=T.DRIFT_SPLIT, ended_at=T.PREDICTION_SPLIT),
)


@query(
    "perturbed_rows",
    """
SELECT id, round(CASE WHEN created_at >= TIMESTAMP '2000-01-01' THEN NULL
                WHEN created_at >= TIMESTAMP '1998-01-01' THEN price + 25 ELSE price + 20 END, 4) AS price,
       CASE WHEN created_at < TIMESTAMP '1998-01-01' AND (id * 2654435761) % 10000 < 5000 THEN 'O' ELSE status END AS status,
       CASE WHEN created_at >= TIMESTAMP '1998-01-01' AND created_at < TIMESTAMP '2000-01-01' THEN 3000.0::DOUBLE
            ELSE 300.0::DOUBLE END AS delay_seconds
FROM preds""",
)
def perturbed_rows(spark, sf_dir):
    df = T.predictions(spark, sf_dir).withColumn("_p", F.from_json("input_features", "price double, status string"))
    at = F.col("created_at")
    columns = scenario.perturbed({"price": F.col("_p.price"), "status": F.col("_p.status")}, _WINDOWED, F.col("id"), at)
    return df.select(
        "id", F.round(columns["price"], 4).alias("price"), columns["status"].alias("status"),
        scenario.label_delay(F.lit(300.0), _WINDOWED, at).alias("delay_seconds"),
    )


@query(
    "welch_statistics",
    """
WITH s AS (SELECT model_id, feature, count(v) FILTER (is_current) AS n1, avg(v) FILTER (is_current) AS m1,
                  var_samp(v) FILTER (is_current) AS v1, count(v) FILTER (NOT is_current) AS n0,
                  avg(v) FILTER (NOT is_current) AS m0, var_samp(v) FILTER (NOT is_current) AS v0
           FROM feat_numeric GROUP BY ALL)
SELECT model_id, feature, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 4) AS t_statistic,
       round((v1 / n1 + v0 / n0)^2 / ((v1 / n1)^2 / (n1 - 1) + (v0 / n0)^2 / (n0 - 1)), 2) AS degrees FROM s""",
)
def welch_statistics(spark, sf_dir):
    from driftlane.plans.drift_queries import _features

    rows = _features(spark, sf_dir).filter("kind = 'numeric'")
    return scenario.welch_statistic(rows, ["model_id", "feature"], "number").select(
        "model_id", "feature", F.round("t_statistic", 4).alias("t_statistic"), F.round("degrees", 2).alias("degrees")
    )


@query(
    "chi_square_statistics",
    """
WITH k AS (SELECT model_id, feature, v, count(*) FILTER (is_current)::DOUBLE AS c,
                  count(*) FILTER (NOT is_current)::DOUBLE AS b FROM feat_category GROUP BY ALL),
t AS (SELECT *, sum(c) OVER g * b / sum(b) OVER g AS e FROM k WHERE b > 0 WINDOW g AS (PARTITION BY model_id, feature))
SELECT model_id, feature, round(sum((c - e)^2 / e), 4) AS chi_square, count(*) - 1 AS degrees FROM t GROUP BY ALL""",
)
def chi_square_statistics(spark, sf_dir):
    from driftlane.plans.drift_queries import _features

    rows = _features(spark, sf_dir).filter("kind = 'categorical'")
    return scenario.chi_square_statistic(rows, ["model_id", "feature"], "category").withColumn(
        "chi_square", F.round("chi_square", 4)
    )
