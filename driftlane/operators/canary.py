"""Metric gate, canary traffic and canary decisions for all tenants."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane import config as C
from driftlane.functions.ids import hash_bucket


def metric_gate(candidates: DataFrame, baselines: DataFrame, as_of: datetime, margin: float = C.GATE_MARGIN) -> DataFrame:
    """Deployment rows for retrained models: canary when F1 improves enough, else rejected.

    ``candidates`` has ``model_name, version, f1``; ``baselines`` has ``model_name,
    f1``; a tenant without one starts from zero.
    """
    base = baselines.select("model_name", F.col("f1").alias("_base"))
    joined = candidates.join(base, "model_name", "left").withColumn("baseline_f1", F.coalesce("_base", F.lit(0.0)))
    required = F.col("baseline_f1") + F.lit(margin)
    passed = F.col("f1") >= required
    reason = F.format_string(
        "F1 of %.4f is below %.4f, which is the serving model's %.4f plus %.4f.",
        F.col("f1"), required, F.col("baseline_f1"), F.lit(margin),
    )
    return joined.select(
        F.concat_ws(":", "model_name", "version").alias("model_id"),
        "model_name", "version", F.col("f1").alias("candidate_f1"), "baseline_f1",
        passed.alias("gate_passed"),
        F.when(passed, "canary").otherwise("rejected").alias("status"),
        F.when(passed, C.CANARY_SHARE_PERCENT).otherwise(0.0).alias("traffic_percentage"),
        F.when(~passed, reason).alias("rejection_reason"),
        F.lit(False).alias("is_current"),
        F.lit(as_of).alias("deployed_at"),
    )


def to_canary(request_id: Column, percent: float | Column) -> Column:
    """Whether a request goes to the canary; the same request always goes the same way."""
    share = F.lit(percent) if isinstance(percent, (int, float)) else percent
    return hash_bucket(request_id) < share * 100


def canary_decisions(
    canaries: DataFrame, alerts: DataFrame, predictions: DataFrame, minimum: int = C.MIN_CANARY_PREDICTIONS
) -> DataFrame:
    """Fail on any alert, promote after enough quiet predictions, otherwise keep watching.

    ``canaries`` has ``model_name, candidate_version, baseline_version``.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("model_id").agg(F.count(F.lit(1)).alias(name))

    ids = canaries.withColumn("model_id", F.concat_ws(":", "model_name", "candidate_version"))
    joined = ids.join(counted(alerts, "_a"), "model_id", "left").join(counted(predictions, "_p"), "model_id", "left")
    n_alerts, n_predictions = F.coalesce("_a", F.lit(0)), F.coalesce("_p", F.lit(0))
    decision = F.when(n_alerts > 0, "canary_failed").when(n_predictions >= minimum, "promoted").otherwise("observing")
    return joined.select(
        "model_name", "candidate_version", "baseline_version",
        n_alerts.alias("alerts_count"), n_predictions.alias("predictions_count"), decision.alias("decision"),
    )


def next_deployments(deployments: DataFrame, decisions: DataFrame, as_of: datetime) -> DataFrame:
    """The deployments table after the decisions: promoted, demoted and failed rows changed."""
    settled = decisions.filter(F.col("decision") != "observing")
    candidate = settled.select(
        F.concat_ws(":", "model_name", "candidate_version").alias("model_id"), F.col("decision").alias("_as_canary")
    )
    demoted = settled.filter(F.col("decision") == "promoted").select(
        F.concat_ws(":", "model_name", "baseline_version").alias("model_id"), F.lit(True).alias("_demoted")
    )
    joined = deployments.join(candidate, "model_id", "left").join(demoted, "model_id", "left")
    promoted, failed = F.col("_as_canary") == "promoted", F.col("_as_canary") == "canary_failed"
    replaced = F.col("_demoted")
    changes = {
        "status": F.when(promoted, "deployed").when(failed, "canary_failed").otherwise(F.col("status")),
        "is_current": F.when(promoted, True).when(failed | replaced, False).otherwise(F.col("is_current")),
        "traffic_percentage": F.when(promoted, 100.0).when(failed | replaced, 0.0).otherwise(F.col("traffic_percentage")),
        "promoted_at": F.when(promoted, F.lit(as_of)).otherwise(F.col("promoted_at")),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in deployments.columns])


def rolled_back(deployments: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """The deployments table after rollbacks: ``rollbacks`` has serving_id and target_id."""
    moves = rollbacks.filter(F.col("target_id").isNotNull()).select(
        F.explode(
            F.array(
                F.struct(F.col("serving_id").alias("id"), F.lit(False).alias("_current")),
                F.struct(F.col("target_id").alias("id"), F.lit(True).alias("_current")),
            )
        ).alias("_m")
    ).select("_m.*")
    joined = deployments.join(moves, "id", "left")
    return joined.select(
        *[F.coalesce("_current", "is_current").alias(c) if c == "is_current" else F.col(c) for c in deployments.columns]
    )
