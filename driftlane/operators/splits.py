"""Deterministic train, test and hold-out splits, and what is counted on them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlane import config as C
from driftlane.functions.ids import hash_order
from driftlane.functions.ranks import values_at_ranks

_BYTES = 6  # so many bytes of text make an exactly representable number
_EXACT = 2**53  # up to here doubles tell whole numbers apart


def _chunk(text: Column, start: int) -> Column:
    """So many bytes of the text from ``start`` as a number that sorts the same way."""
    part = F.hex(F.substring(F.encode(text, "UTF-8"), start + 1, _BYTES))
    return F.conv(F.rpad(part, 2 * _BYTES, "0"), 16, 10).cast("double")


def _half(number: Column, depth: int) -> Column:
    """The upper, then the lower 32 bits of a whole number; each is exact as a double."""
    whole = number.cast("bigint")
    return (F.shiftright(whole, 32) if depth == 0 else whole.bitwiseAND(F.lit(0xFFFFFFFF))).cast("double")


def _common_bytes(first: str, last: str) -> int:
    """How many leading bytes all texts between two share."""
    return len(os.path.commonprefix([first.encode(), last.encode()]))


def id_at_rank(df: DataFrame, column: str, rank: int):
    """The ``rank``-th smallest id (from zero), found by counting, not by sorting.

    Numbers that doubles tell apart take one search; other whole numbers are compared by
    halves and text a few bytes at a time, after the bytes that all ids share, so that
    every step is exact; each round looks only at the ids that share what was found so
    far. Ids must be unique; the rank must be below their number.
    """
    kind = df.schema[column].dataType
    id_column = F.col(column)
    if isinstance(kind, T.DecimalType):
        if kind.scale or kind.precision > 18:
            raise TypeError("ids are whole numbers, doubles or text")
        df, kind = df.withColumn(column, id_column.cast("bigint")), T.LongType()
    first, last = df.agg(F.min(id_column), F.max(id_column)).first()
    exact = isinstance(kind, (T.DoubleType, T.FloatType))
    whole = isinstance(kind, T.NumericType) and not exact
    exact = exact or (whole and -_EXACT <= first and last <= _EXACT)
    start = 0 if isinstance(kind, T.NumericType) else _common_bytes(first, last)
    ids = df.select(column, F.lit(0).alias("_all"))
    depth = 0
    while True:
        code = id_column.cast("double") if exact else _half(id_column, depth) if whole else _chunk(id_column, start + depth * _BYTES)
        coded = ids.withColumn("_code", code)
        value = values_at_ranks(coded, ["_all"], "_code", lambda _, r=rank: F.array(F.lit(r).cast("bigint"))).first().value
        if exact:
            return int(value) if whole else value
        here = coded.filter(F.col("_code") == value)
        below, same, smallest = coded.agg(
            F.count_if(F.col("_code") < value), F.count_if(F.col("_code") == value),
            F.min(F.when(F.col("_code") == value, id_column)),
        ).first()
        if same == 1 or (whole and depth == 1):
            return smallest
        rank -= below
        if not whole and not here.filter(F.length(F.encode(column, "UTF-8")) > start + (depth + 1) * _BYTES).limit(1).count():
            return smallest
        ids, depth = here.drop("_code"), depth + 1


def ordered_holdout(df: DataFrame, column: str, fraction: float = C.HOLDOUT_FRACTION) -> DataFrame:
    """Adds ``held_out``: true for the last ``fraction`` of rows in id order; no rows hold out none."""
    total = df.count()
    cut = int(total * (1 - fraction))
    if cut >= total:
        return df.withColumn("held_out", F.lit(False))
    first = id_at_rank(df, column, cut)
    return df.withColumn("held_out", F.col(column) >= F.lit(first))


def stratified_split(df: DataFrame, label: str, row_id: str, fraction: float = C.TEST_FRACTION) -> DataFrame:
    """Adds ``is_test``: the rows with the smallest id hashes, the same share of each class.

    The hash that ends the test share is found per class by counting; no class is
    sorted or moved.
    """
    hashed = df.withColumn("_hash", hash_order(F.col(row_id)))

    def size(total: Column) -> Column:
        return F.floor(total * fraction + 0.5).cast("bigint")

    last = values_at_ranks(hashed, [label], "_hash", lambda total: F.array(F.greatest(size(total) - 1, F.lit(0))))
    limits = last.select(
        F.col(label).alias("_class"), F.when(size(F.col("total")) > 0, F.col("value")).otherwise(-1.0).alias("_last")
    )
    return (
        hashed.join(limits, F.col(label) == F.col("_class"), "left")
        .withColumn("is_test", F.coalesce(F.col("_hash") <= F.col("_last"), F.lit(False)))
        .drop("_hash", "_class", "_last")
    )


def class_distribution(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_positive"),
        F.avg(F.col(label)).alias("positive_rate"),
    )


def majority_baseline(split: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Accuracy on the test rows of always answering the commonest training class."""
    counts = split.groupBy(*keys, label).agg(
        F.count_if(~F.col("is_test")).alias("_train"), F.count_if("is_test").alias("_test")
    )
    # Equal counts go to the smaller class.
    commonest = F.max(F.struct(F.col("_train"), (-F.col(label)).alias("neg"), F.col("_test")))
    return counts.groupBy(*keys).agg(commonest.alias("_top"), F.sum("_test").alias("n_test")).select(
        *keys, (-F.col("_top.neg")).alias("majority_class"), "n_test",
        F.try_divide(F.col("_top._test").cast("double"), F.col("n_test")).alias("accuracy"),
    )


def next_version(deployments: DataFrame) -> DataFrame:
    number = F.regexp_extract("version", r"(\d+)", 1).try_cast("int")
    return deployments.groupBy("model_id").agg(
        F.concat(F.lit("v"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_version")
    )
