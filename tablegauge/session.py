"""Session settings the jobs expect, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Set when a session is built; it cannot be changed later. Call-site tracking costs several round
# trips to the JVM per column expression, which shows on plans over many columns.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def apply_session_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on; sizes stay the cluster's choice."""
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables, as the cluster names it.

    The cluster sets `spark.checkpoint.dir`. Only a local session, where nothing is configured,
    gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tablegauge-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back, cutting its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def rewritten(df: DataFrame) -> DataFrame:
    """Write `df` as a table below the checkpoint folder and read it back.

    For rounds that join a table with itself: unlike a checkpoint, a table read back carries no
    constraints of the plan that made it, which double from round to round.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by `keys` in as many partitions as the session shuffles to; adaptive execution does not merge them.

    It merges by compressed size, and rows of a few ids compress so well that a task that groups them
    would need many times the memory of others. Only for keys that no large part of the rows shares.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def local_rows(df: DataFrame) -> DataFrame:
    """Run a frame of schema-bounded size (one row, or one row per column) exactly once.

    Only for frames whose row count is fixed by the schema or the configuration, never by
    the data: the rows pass through the driver and come back as a local relation.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
