"""Session helpers: shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session used by the tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gaugeline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="gaugeline-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def broadcast_if_small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table of a few rows per group, written once; broadcast only after its rows were counted."""
    from pyspark.sql import functions as F

    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= most else stored


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive a lost executor and are not computed twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
