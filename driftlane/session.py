"""Session set-up and the two cluster helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "driftlane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; cluster settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The JVM does not compile methods above 8000 bytes; split such plans instead.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Recording the Python line of every column expression slows plan building.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that cut-off results go to, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a scratch folder; on a cluster
    executors would lose a machine-local folder together with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="driftlane-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later passes all see the same rows, also when an executor is lost in between,
    and the plan of ``df`` is not run again. Because the files have a known size,
    Spark broadcasts the table in a join if and only if that size is below
    ``spark.sql.autoBroadcastJoinThreshold``, and shuffles otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
