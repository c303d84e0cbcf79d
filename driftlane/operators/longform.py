"""Wide feature rows and JSON payloads as one long table.

Long rows are ``model_id, kind, feature, number, category``. ``kind`` is
``numeric``, ``categorical`` or ``rows``; the last is one marker per source row, so
sample sizes come out of the same scan and shuffle as the bins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "_rows"
PREDICTION = "_prediction"


def _entry(kind: str, feature: str, number: Column | None = None, category: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(feature).alias("feature"),
        (none if number is None else number).try_cast("double").alias("number"),
        (none if category is None else category).cast("string").alias("category"),
    )


def feature_rows(
    df: DataFrame,
    numeric: Mapping[str, Column],
    categorical: Mapping[str, Column],
    keep: Sequence[str] = ("model_id",),
) -> DataFrame:
    """Unpivot typed columns; nulls stay, so that they can be counted."""
    entries = [_entry("rows", ROWS)]
    entries += [_entry("numeric", name, number=value) for name, value in numeric.items()]
    entries += [_entry("categorical", name, category=value) for name, value in categorical.items()]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_e")).select(*keep, "_e.*")


def payload_rows(
    predictions: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    payload: str = "input_features",
    confidence: str | None = "confidence",
    keep: Sequence[str] = ("model_id",),
) -> DataFrame:
    """The same long form from a JSON payload, parsed once per row.

    A number that does not parse is null. The confidence becomes one more numeric
    feature, ``_prediction``.
    """
    fields = ", ".join(f"`{name}` string" for name in (*numeric, *categorical))
    parsed = predictions.withColumn("_p", F.from_json(payload, fields))
    numbers = {name: F.col("_p")[name].try_cast("double") for name in numeric}
    if confidence:
        numbers[PREDICTION] = F.col(confidence)
    return feature_rows(parsed, numbers, {name: F.col("_p")[name] for name in categorical}, keep)


def payload_entries(
    predictions: DataFrame, payload: str = "input_features", keep: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Every field of a payload whose schema is not known: ``feature, text``."""
    return predictions.select(
        *keep, F.explode(F.from_json(payload, "map<string,string>")).alias("feature", "text")
    )


def usable_number(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number)
