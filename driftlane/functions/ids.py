"""Tenant identifiers and repeatable hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def model_name(model_id: Column) -> Column:
    """``name:version`` -> ``name``; an id without a colon is the name itself."""
    return F.when(model_id.contains(":"), F.split_part(model_id, F.lit(":"), F.lit(1))).otherwise(model_id)


def model_version(model_id: Column) -> Column:
    return F.when(model_id.contains(":"), F.split_part(model_id, F.lit(":"), F.lit(2)))


def hash_bucket(row_id: Column, buckets: int = 10_000) -> Column:
    """A re-runnable stand-in for a random roll, for ids of any size and for text.

    A whole number is taken modulo ``buckets`` before it is multiplied, which leaves the
    same bucket and can't overflow; other ids go by the number of their md5.
    """
    number = F.coalesce(row_id.try_cast("bigint"), hash_order(row_id))
    return F.pmod(F.pmod(number, F.lit(buckets)) * F.lit(2654435761), F.lit(buckets))


def hash_order(row_id: Column) -> Column:
    """A uniform 48-bit number from the md5 of any id, for hash-ordered splits."""
    return F.conv(F.substring(F.md5(row_id.cast("string")), 1, 12), 16, 10).cast("bigint")
