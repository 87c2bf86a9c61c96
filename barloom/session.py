"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "barloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster ``master`` and ``partitions`` stay unset: the submit command names the master, and
    AQE picks the final partition count from an initial one that suits the cluster.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and written tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and Spark runs
    in one process (tests, local runs) a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table under the shared folder."""
    return os.path.join(shared_dir(spark), "barloom", f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: for results that several plans use.
    Unlike a cache it survives the loss of executors."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
