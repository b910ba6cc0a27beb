"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "churnkit", shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every job here assumes.

    * UTC session time zone (dates derived from timestamps must not shift),
    * AQE on (coalesces tiny shuffles, splits skewed join partitions at runtime),
    * Arrow for the few pandas UDFs,
    * no UI server.

    The master and the number of shuffle partitions are the cluster's (``spark-submit``) unless asked for.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # checkpoint files of DataFrames that went out of scope are removed by the context cleaner
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("CHURNKIT_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    On a cluster the setting names a shared, fault-tolerant folder and is used as is.
    Only when it is unset on a one-machine ``local[...]`` master (tests) a scratch folder is created and
    registered; anywhere else an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        configured = os.path.join(tempfile.gettempdir(), f"churnkit-ckpt-{os.getuid()}")
        os.makedirs(configured, mode=0o700, exist_ok=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def lasting_dir(spark: SparkSession) -> str:
    """The folder above this session's checkpoints: what is stored there outlives the session."""
    own = checkpoint_dir(spark).rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else own.rpartition("/")[0]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used at the stage boundaries that many later jobs reuse (model matrix, split),
    so a lost executor re-reads the checkpoint instead of recomputing the whole plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
