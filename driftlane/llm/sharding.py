"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Documents of one text are a group and go together. A group is a vector of bytes, tokens
and rows, measured in shares of a shard; it is placed where the dot product of its vector
with what the shards have left is highest, the largest groups first. Groups that are
large against a shard are few and are placed in one go. The others are dealt into
parts at random, and every part is packed by a task of its own into its portion of what
is left, so the whole is as even as its parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlane.functions.positions import SALT, positions, salted
from driftlane.llm.mixing import size_of
from driftlane.session import materialise

MEASURES = ["bytes", "tokens", "rows"]
#: A group above this part of a shard, in any measure, is placed before the others. There are at most
#: 3 x 64 such groups per shard, because each takes a 64th of a shard in some measure.
LARGE = 1 / 64
#: A group that is more than a shard is split into pieces of about this part of a shard.
PIECE = 1 / 32
#: Smaller groups that one task packs, about.
PART = 50_000
_PLACED = "k1 bigint, k2 bigint, piece bigint, shard int"


def pack(vectors: np.ndarray, left: np.ndarray, first: int = 0) -> np.ndarray:
    """The shard of each vector, given what the shards have ``left`` (one row per shard, may be negative).

    Vectors come in falling order of their largest measure. Among the shards with room
    in every measure, or among all if there is none, the highest dot product wins; ties
    go to the first shard, counted from ``first``.
    """
    turn = np.roll(np.arange(len(left)), -first)
    left = left[turn].copy()
    chosen = np.empty(len(vectors), dtype=np.int64)
    for n in np.lexsort((*vectors.T, -vectors.max(axis=1))) if len(vectors) else ():
        vector = vectors[n]
        scores = left @ vector
        room = (left >= vector).all(axis=1)
        best = int(np.argmax(np.where(room, scores, -np.inf))) if room.any() else int(np.argmax(scores))
        left[best] -= vector
        chosen[n] = turn[best]
    return chosen


def _packer(left: np.ndarray, measured: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one part of the groups into its portion of ``left``; ``measured`` is a whole shard."""

    def packed(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["k1", "k2", "piece"])
        vectors = groups[MEASURES].to_numpy(dtype=float) / measured
        open_ = np.maximum(left, 0)
        portion = vectors.sum(axis=0) / np.maximum(open_.sum(axis=0), 1e-300)
        # Parts start at different shards, so that their remainders don't add up in one.
        first = int(groups["k1"].iloc[0] % len(left))
        shards = pack(vectors, open_ * portion, first)
        return groups[["k1", "k2", "piece"]].assign(shard=shards.astype(np.int32))

    return packed


def _shares(df: DataFrame) -> list[float]:
    row = df.agg(*[F.sum(m).cast("double").alias(m) for m in MEASURES]).first()
    return [row[m] or 0.0 for m in MEASURES]


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """One row per document: ``doc_id, size, tokens, text_crc32, shard, slot``; ``slot`` counts from 0 in each shard.

    The size is the text's UTF-8 bytes and ``overhead``. Equal texts share a shard, unless
    together they are more than a shard in bytes, tokens or rows; then they are split
    into equal pieces. A single document is never split.

    Null text counts as empty and null ids come first in a shard; documents of one id are
    in the order of their texts' hashes; repeated rows are documents of their own. A very
    long text is read in memory of its own size. Other columns don't count. An empty table
    gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialise(salted(docs.select(
        "doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text) + overhead).cast("bigint").alias("bytes"), size_of(text).alias("tokens"), F.lit(1).cast("bigint").alias("rows"),
    )))
    key = ["k1", "k2"]
    groups = materialise(rows.groupBy(*key).agg(*[F.sum(m).alias(m) for m in MEASURES]))
    measured = np.maximum(np.array(_shares(groups)) / shards, 1e-9)

    def filled(*names: str):
        return F.greatest(*[F.col(m) / F.lit(float(s)) for m, s in zip(names, measured)])

    # At most one group per shard and measure is more than a shard.
    split = materialise(groups.where((filled(*MEASURES) > 1) & (F.col("rows") > 1)).select(
        *key, F.col("rows").alias("of"), F.least("rows", F.ceil(filled(*MEASURES) / PIECE)).cast("bigint").alias("pieces")
    ))
    ranked = positions(rows.join(split, key), key, ["doc_id", SALT], "n").drop("lot")
    split_rows = ranked.withColumn("piece", F.floor(F.col("n") * F.col("pieces") / F.col("of")).cast("bigint")).drop("n", "pieces", "of")
    whole_rows = rows.join(split.select(*key, "pieces"), key, "left").where("pieces IS NULL").withColumn("piece", F.lit(0).cast("bigint"))
    split_rows = materialise(split_rows)
    units = groups.join(split.select(*key, "pieces"), key, "left").where("pieces IS NULL").select(
        *key, F.lit(0).cast("bigint").alias("piece"), *MEASURES
    ).unionByName(split_rows.groupBy(*key, "piece").agg(*[F.sum(m).alias(m) for m in MEASURES]))
    units = materialise(units)

    large = filled(*MEASURES) > LARGE
    left = np.ones((shards, len(MEASURES)))
    placed = materialise(units.where(large).groupBy(F.lit("all").alias("all")).applyInPandas(_packer(left, measured), _PLACED))
    unit = [*key, "piece"]
    taken = units.join(placed, unit).groupBy("shard").agg(*[F.sum(m).cast("double").alias(m) for m in MEASURES])
    for row in taken.collect():  # one row per shard
        left[row["shard"]] -= np.array([row[m] for m in MEASURES]) / measured
    small = units.where(~large)
    parts = -(-small.count() // PART) or 1
    part = F.pmod(F.xxhash64(F.lit(2), *unit), F.lit(parts))
    rest = materialise(small.groupBy(part.alias("part")).applyInPandas(_packer(left, measured), _PLACED))

    columns = ["doc_id", "bytes", "tokens", "text_crc32", *unit, SALT]
    rows = split_rows.select(*columns).unionByName(whole_rows.select(*columns))
    # The rows of large groups meet the few of those first, so that they aren't a hot key of the second join.
    rows = rows.join(placed.withColumnRenamed("shard", "of_large"), unit, "left")
    dealt = rows.where("of_large IS NOT NULL").withColumnRenamed("of_large", "shard").unionByName(
        rows.where("of_large IS NULL").drop("of_large").join(rest, unit)
    )
    return positions(dealt, ["shard"], ["doc_id", *key, SALT], "slot").select(
        "doc_id", F.col("bytes").alias("size"), "tokens", "text_crc32", "shard", "slot"
    )
