"""Ranks of the elements of linked lists, by contraction to rulers and pointer doubling.

An element knows only the next one. A random part of the elements are rulers; doubled
pointers take every element to the next ruler in a few rounds, in which ever fewer
elements are still on their way. The rulers form a list of a thirty-second of the
length, which is ranked in the same manner, until one task can walk through the rest.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.session import materialise, shared_folder

#: One in so many elements is a ruler; lists no longer than the second number are walked through.
ONE_IN, WALKED = 32, 8192
_RANKED = "element bigint, rank bigint"


def _is_ruler(element: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(element, F.lit(level)), F.lit(ONE_IN)) == 0


def _walk(links: pd.DataFrame) -> pd.DataFrame:
    """The ranks of a short list: from its start each element is the sum of the hops to the end."""
    to = {int(e): (None if pd.isna(t) else int(t), int(h)) for e, t, h in zip(links["element"], links["to"], links["hops"])}
    targets = {t for t, _ in to.values()}
    ranks = {}
    for start in [e for e in to if e not in targets]:
        way = [start]
        while to[way[-1]][0] is not None:
            way.append(to[way[-1]][0])
        rank = 0
        for e in reversed(way):
            rank += to[e][1]
            ranks[e] = rank
    return pd.DataFrame({"element": list(ranks), "rank": list(ranks.values())})


def _to_rulers(links: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """``element, to, hops`` with ``to`` the next ruler (or null), of the rulers and of the other elements."""
    spark = links.sparkSession
    arrived = F.col("to").isNull() | _is_ruler(F.col("to"), level)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def read(*parts: str) -> DataFrame:
        return spark.read.schema(links.schema).parquet(*parts)

    parts = []
    under_way = links
    while True:
        # What has arrived in this round stays in the round's file and isn't written again.
        parts.append(f"{folder}/arrived-{len(parts)}")
        under_way.where(arrived).write.parquet(parts[-1])
        rest = f"{folder}/rest-{len(parts)}"
        under_way.where(~arrived).write.parquet(rest)
        rest = read(rest)
        if rest.isEmpty():
            done = read(*parts)
            ruler = _is_ruler(F.col("element"), level)
            return done.where(ruler), done.where(~ruler)
        known = read(*parts).unionByName(rest).where(~_is_ruler(F.col("element"), level))
        under_way = materialise(
            rest.alias("a").join(known.alias("b"), F.col("a.to") == F.col("b.element"))
            .select("a.element", "b.to", (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        )


def list_ranks(links: DataFrame) -> DataFrame:
    """``element, rank`` of ``element, to`` (null at an end): the number of elements from each one to its end, itself included.

    Elements are distinct, and each is the next one of at most one other.
    """
    current = materialise(links.select(
        F.col("element").cast("bigint").alias("element"), F.col("to").cast("bigint").alias("to"), F.lit(1).cast("bigint").alias("hops")
    ))
    others = []
    while current.count() > WALKED:
        rulers, rest = _to_rulers(current, len(others))
        others.append(rest)
        current = materialise(rulers)
    ranks = materialise(current.groupBy(F.lit("all").alias("all")).applyInPandas(_walk, _RANKED))
    for rest in reversed(others):
        met = rest.alias("a").join(ranks.alias("b"), F.col("a.to") == F.col("b.element"), "left").select(
            "a.element", (F.col("a.hops") + F.coalesce("b.rank", F.lit(0))).alias("rank")
        )
        ranks = materialise(ranks.unionByName(met))
    return ranks
