"""The corpus pipeline: documents through five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm import secrets, toxicity
from driftlane.llm.common import row_key, table
from driftlane.llm.decontamination import decontaminate
from driftlane.llm.mixing import MADE, fair_queue
from driftlane.llm.order_minhash import near_duplicates
from driftlane.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_texts(model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays, once: of the least id, or one without if none has an id."""
    classes = near_duplicates(docs)
    # One row per id and text that stays; several only where rows are repeated.
    kept = classes.where("key = kept_key").groupBy("kept_key").agg(F.count("*").alias("n_rows")).hint("merge")
    found = docs.withColumn("kept_key", row_key(F.col("doc_id"), F.col("text"))).join(kept, "kept_key")
    single = found.where("n_rows = 1").select(docs.columns)
    repeated = found.where("n_rows > 1").dropDuplicates(["kept_key"])
    return single.unionByName(repeated.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    # What is dropped grows with the corpus: always merged, never broadcast.
    hit = found.where("contaminated").select(F.col("key").alias("hit_key")).distinct().hint("merge")
    return docs.join(hit, row_key(F.col("doc_id"), F.col("text")) == F.col("hit_key"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets are replaced by their kind."""
    return secrets.mask_secrets(docs, secrets.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of each and when it takes the first copy."""
    mixed = fair_queue(docs, keep=tuple(docs.columns)).where("taken > 0")
    return mixed.select(
        *[f"{c}_given" if c in MADE and c != "doc_id" else c for c in docs.columns], "size", "source_size", "target", "taken", F.size("slots").alias("n_copies"),
        F.get("slots", F.lit(0))["finish"].alias("finish"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
#: Learned models and sketches can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
