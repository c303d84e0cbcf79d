"""Cleaning and record validation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.config import Tenant

# How label texts are read; anything else counts as negative.
_POSITIVE = ("yes", "true", "1")


def lenient_number(text: Column) -> Column:
    """A number, or null where the text is blank or not one."""
    return text.try_cast("double")


def number_or_zero(text: Column) -> Column:
    return F.coalesce(lenient_number(text), F.lit(0.0))


def binary_label(label: Column) -> Column:
    return F.when(F.lower(F.trim(label.cast("string"))).isin(*_POSITIVE), 1).otherwise(0)


def prediction_label(prediction: Column, tenant: Tenant) -> Column:
    negative, positive = tenant.labels
    return F.when(prediction, positive).otherwise(negative)


def preprocess(df: DataFrame, tenant: Tenant) -> DataFrame:
    """Features in declared order with lenient numbers, and a 0/1 label; the id is dropped."""
    label = [binary_label(F.col(tenant.target)).alias(tenant.target)] if tenant.target in df.columns else []
    present = set(df.columns)
    return df.select(
        *[lenient_number(F.col(c).cast("string")).alias(c) for c in tenant.numeric if c in present],
        *[F.col(c).cast("string").alias(c) for c in tenant.categorical if c in present],
        *label,
    )


def training_rows(raw: DataFrame, tenant: Tenant) -> DataFrame:
    """What training starts from: the id, the features as ``preprocess`` cleans them, and the 0/1 ``label``."""
    return raw.select(
        F.col(tenant.id_column),
        *[lenient_number(F.col(c).cast("string")).alias(c) for c in tenant.numeric],
        *[F.col(c).cast("string").alias(c) for c in tenant.categorical],
        binary_label(F.col(tenant.target)).alias("label"),
    )


def _field_violations(tenant: Tenant) -> list[Column]:
    checks = []
    for name in tenant.numeric:
        text = F.col(name).cast("string")
        number = lenient_number(text)
        checks.append(
            F.when(text.isNull(), f"missing:{name}")
            .when(number.isNull() | F.isnan(number), f"not_a_number:{name}")
            .when(number < 0, f"negative:{name}")
        )
    for name in tenant.categorical:
        value = F.col(name).cast("string")
        checks.append(
            F.when(value.isNull(), f"missing:{name}").when(~value.isin(*tenant.domains[name]), f"domain:{name}")
        )
    return checks


def implausible_total(tenure: Column, monthly: Column, total: Column) -> Column:
    """Charges to date may exceed tenure times the monthly charge by a tenth, plus one."""
    return (tenure > 0) & (total > tenure * monthly * 1.10 + 1)


def validate(df: DataFrame, tenant: Tenant) -> DataFrame:
    """Adds ``violations``, empty for a valid record.

    The rule across fields is only looked at when every single field is right.
    """
    fields = F.filter(F.array(*_field_violations(tenant)), lambda v: v.isNotNull())
    checked = df.withColumn("violations", fields)
    if "TotalCharges" not in tenant.numeric:
        return checked
    tenure, monthly, total = (lenient_number(F.col(c).cast("string")) for c in ("tenure", "MonthlyCharges", "TotalCharges"))
    across = (F.size("violations") == 0) & implausible_total(tenure, monthly, total)
    return checked.withColumn(
        "violations", F.when(across, F.array(F.lit("implausible:TotalCharges"))).otherwise(F.col("violations"))
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and quarantined ones with their violations."""
    valid = F.size("violations") == 0
    return validated.filter(valid).drop("violations"), validated.filter(~valid)


def validity_counts(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: records sent, accepted and rejected."""
    valid = F.size("violations") == 0
    return validated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sent"), F.count_if(valid).alias("n_ok"), F.count_if(~valid).alias("n_rejected")
    )


def violation_counts(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        validated.select(*keys, F.explode("violations").alias("reason"))
        .groupBy(*keys, "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
