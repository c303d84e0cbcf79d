"""Preprocessing statistics, training and scoring over the given tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftlane.config import Tenant
from driftlane.operators import modeling, profile
from driftlane.plans.registry import query
from driftlane.session import materialise
from driftlane.sources import driver_tables as T

# Does an order contain a returned line? From its price, customer and status.
ORDERS = Tenant(
    name="order-model", id_column="id", target="label",
    numeric=("price", "segment"), categorical=("status", "priority"),
)


def training_rows(spark, sf_dir):
    labels = T.outcomes(spark, sf_dir)
    orders = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
        F.nullif(F.col("o_custkey") % 100, F.lit(0)).cast("double").alias("segment"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
    )
    return orders.join(labels, orders["id"] == labels["prediction_id"]).select(
        *orders.columns, F.col("true_label").cast("int").alias("label")
    )


_ROWS = """
rows_in AS (SELECT o_orderkey AS id, o_totalprice AS price, CAST(nullif(o_custkey % 100, 0) AS DOUBLE) AS segment,
                   nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority
            FROM orders JOIN outs ON o_orderkey = prediction_id)"""


@query(
    "imputation_and_scaling",
    f"""WITH {_ROWS},
long AS (SELECT 'price' AS feature, price AS v FROM rows_in UNION ALL SELECT 'segment', segment FROM rows_in),
medians AS (SELECT feature, median(v) AS median FROM long GROUP BY feature)
SELECT feature, round(any_value(median), 4) AS median, round(avg(coalesce(v, median)), 4) AS mean,
       round(stddev_pop(coalesce(v, median)), 4) AS std FROM long JOIN medians USING (feature) GROUP BY feature""",
)
def imputation_and_scaling(spark, sf_dir):
    stats = modeling.numeric_statistics(materialise(training_rows(spark, sf_dir)), ORDERS.numeric)
    return stats.select("feature", *[F.round(c, 4).alias(c) for c in ("median", "mean", "std")])


@query(
    "category_codes",
    f"""WITH {_ROWS},
cats AS (SELECT DISTINCT 'status' AS feature, coalesce(status, 'missing') AS category FROM rows_in
         UNION SELECT DISTINCT 'priority', coalesce(priority, 'missing') FROM rows_in)
SELECT feature, category, CAST(row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS INT) AS code FROM cats""",
)
def category_codes(spark, sf_dir):
    return modeling.category_codes(training_rows(spark, sf_dir), ORDERS.categorical)


@query(
    "preprocessed_rows",
    f"""WITH {_ROWS},
s AS (SELECT median(price) AS mp, median(segment) AS ms FROM rows_in),
z AS (SELECT mp, ms, avg(price) AS ap, stddev_pop(price) AS dp, avg(coalesce(segment, ms)) AS am,
             stddev_pop(coalesce(segment, ms)) AS dm FROM rows_in, s GROUP BY mp, ms)
SELECT id, round((price - ap) / dp, 4) AS price, round((coalesce(segment, ms) - am) / dm, 4) AS segment,
       CAST(dense_rank() OVER (ORDER BY coalesce(status, 'missing')) - 1 AS DOUBLE) AS status,
       CAST(dense_rank() OVER (ORDER BY priority) - 1 AS DOUBLE) AS priority FROM rows_in, z""",
)
def preprocessed_rows(spark, sf_dir):
    rows = materialise(training_rows(spark, sf_dir))
    prepared = rows
    for stage in modeling.preprocessing(rows, ORDERS):
        prepared = stage.transform(prepared)
    values = vector_to_array("features")
    return prepared.select(
        "id", F.round(values[0], 4).alias("price"), F.round(values[1], 4).alias("segment"),
        values[2].alias("status"), values[3].alias("priority"),
    )


@query(
    "fit_optimality",
    "SELECT CAST(place AS INT) AS place, 0.0::DOUBLE AS gradient FROM range(0, 5) r(place)",
)
def fit_optimality(spark, sf_dir):
    """Four coefficients and the intercept: the gradient of the objective at the fit, which is zero at the optimum only."""
    rows = materialise(training_rows(spark, sf_dir))
    found = modeling.gradient(modeling.fit(rows, ORDERS), rows)
    return found.select("place", F.abs(F.round("gradient", 4)).alias("gradient"))


@query("train_and_evaluate")
def train_and_evaluate(spark, sf_dir):
    return modeling.train_model(training_rows(spark, sf_dir), ORDERS).metrics


@query("retrain_with_gate")
def retrain_with_gate(spark, sf_dir):
    rows = materialise(training_rows(spark, sf_dir))
    # The serving model knows the older orders only.
    current = modeling.fit(rows.filter(F.col("created_at") < F.lit(T.PREDICTION_SPLIT)), ORDERS)
    decision, _ = modeling.retrain(rows, ORDERS, current, "v2", T.PREDICTIONS_AS_OF)
    return decision


@query("batch_scores")
def batch_scores(spark, sf_dir):
    rows = materialise(training_rows(spark, sf_dir))
    model = modeling.fit(rows, ORDERS)
    return modeling.score(model, rows).select("id", "prediction", "confidence")


@query("score_profile_of_trained_model")
def score_profile_of_trained_model(spark, sf_dir):
    rows = materialise(training_rows(spark, sf_dir))
    scored = modeling.score(modeling.fit(rows, ORDERS), rows).select(
        F.lit("order-model:v1").alias("model_id"), "prediction", F.col("probability_1").alias("confidence")
    )
    return profile.prediction_profile(scored)
