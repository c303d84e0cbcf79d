"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, served again from the
start until a document has had ``repeats`` copies. A copy's virtual finish time is the
number of its source's words up to its end, divided by the source's target. Serving in
order of finish time keeps the sources at their weights all along, and the budget is
used up at virtual time 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.session import materialise

TOKEN = r"[^\x20\x09-\x0D]+"
BIN_DIGITS = 3
#: Names of the result.
MADE = ("doc_id", "size", "source_size", "target", "slots", "taken")


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """One row per source: its size and the words the mix wants of it.

    The budget, ``share`` times all words, is split by weight; no target exceeds
    ``repeats`` times its source, the rest is shared again by weight. Ordered by the
    level at which they are full, the sources before a row are full if it isn't, so
    the level follows from running sums. The windows have one row per source.
    """
    per_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    cap = F.col("source_size") * repeats
    weighted = per_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ).withColumns({"cap": cap, "full_at": cap.cast("double") / F.col("weight")})
    by_level = Window.orderBy("full_at", "source_key")
    everything = Window.orderBy("full_at", "source_key").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    budget = F.sum("source_size").over(everything).cast("double") * share
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    levelled = weighted.withColumn("level", left / F.sum("weight").over(onward))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_key", "level"))).over(everything)
    level = first.getField("level")
    return levelled.withColumn("reached", level).select(
        "source_key", "source_size",
        F.when(F.col("reached").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("reached") * F.col("weight"))).alias("target"),
    )


def fair_queue(
    docs: DataFrame, keep: tuple[str, ...] = (), weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
    repeats: int = 2, id_column: str = "doc_id",
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, slots, taken`` and the columns in ``keep``.

    A kept column with the name of one of these comes back as ``<name>_given``.

    ``slots`` has ``(round, finish, words)`` for each copy that the mix takes; the copy
    that the budget ends in is taken in part, so a source takes its target to the word.
    ``taken`` is their sum. Documents are shuffled by a digest of their id and size, so
    reruns agree. Positions in a queue come from word sums per 4096th of the shuffled order
    and a window inside each, so that no task holds a whole source.

    Null text has no words, a null source is a source of its own and comes last, null
    ids shuffle together. Repeated rows each get their own place. Documents without
    words take nothing. An empty table gives an empty result.
    """
    source = F.col("source")
    # With the size, so that rows without an id are spread as well.
    shuffled = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    sized = docs.select(
        F.col(id_column).alias("doc_id"), *[F.col(c).alias(f"_kept_{c}") for c in keep if c != id_column],
        F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source)).alias("source_key"),
        size_of(F.col("text")).alias("size"),
    )
    sizes = materialise(sized.withColumn("place", shuffled).withColumn("bin", F.substring("place", 1, BIN_DIGITS)))
    targets = source_targets(sizes, weights, share, repeats)
    bins = sizes.groupBy("source_key", "bin").agg(F.sum("size").alias("in_bin"))
    ahead = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        "source_key", "bin", F.coalesce(F.sum("in_bin").over(ahead), F.lit(0)).alias("ahead")
    ).join(targets, "source_key")
    inside = Window.partitionBy("source_key", "bin").orderBy("place", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = sizes.withColumn("end", F.sum("size").over(inside)).join(bins, ["source_key", "bin"]).withColumn(
        "start", F.col("ahead") + F.col("end") - F.col("size")
    )
    limit = F.floor("target")

    def slot(number: int) -> Column:
        start = F.col("start") + F.lit(number) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), limit - start)).cast("bigint")
        return F.struct(
            F.lit(number).alias("round"), ((start + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0))).alias("finish"),
            words.alias("words"),
        )

    slots = F.filter(F.array(*[slot(i) for i in range(repeats)]), lambda s: s["words"] > 0)
    return placed.withColumn("slots", slots).select(
        "doc_id", *[F.col(f"_kept_{c}").alias(f"{c}_given" if c in MADE else c) for c in keep if c != id_column],
        "size", "source_size", "target", "slots",
        F.aggregate("slots", F.lit(0).cast("bigint"), lambda total, s: total + s["words"]).alias("taken"),
    )


def training_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """The mix itself: one row per copy taken, in global order of virtual finish time."""
    copies = mixed.withColumn("slot", F.explode("slots")).drop("slots").select(
        "*", "slot.round", "slot.finish", "slot.words"
    ).drop("slot")
    return copies.repartitionByRange(partitions, "finish", "doc_id", "round").sortWithinPartitions("finish", "doc_id", "round")
