"""Session defaults and the durable cut point used to end long lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text work is CPU-bound: do not fold small shuffles into a single task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Checkpoint files go when their DataFrame does.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.pythonUDF.arrow.enabled": "true",
}


def build_session(
    app_name: str = "voltmap", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on (UTC, map key policy)."""
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.mapKeyDedupPolicy",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize",
    ):
        spark.conf.set(key, DEFAULTS[key])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It comes from ``spark.checkpoint.dir``.  Only a local session without that setting
    (a test run) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        configured = spark.conf.get(CHECKPOINT_KEY, None)
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder on a cluster")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="voltmap-ckpt-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint `df` into the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def nothing(spark: SparkSession, schema) -> DataFrame:
    """No rows of a schema, which the optimizer knows: a join with it moves no rows."""
    return spark.createDataFrame([], schema).limit(0)


def few(df: DataFrame, most: int = 50_000) -> bool:
    """Whether a checkpointed `df` of short rows has so few of them that all tasks can hold them."""
    return df.limit(most + 1).count() <= most
