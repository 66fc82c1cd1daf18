"""Session settings shared by iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width; order-based operators cut into this many ranges."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a ``local`` master, where driver
    and executors are one process, may leave it unset and gets a temporary folder; elsewhere
    executors would write to disks that nobody else reads, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if root is None:
        root = sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and cuts the lineage of a loop."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def materialized(df: DataFrame) -> DataFrame:
    """Write a table that several jobs will read to the shared folder and read it back.

    Upstream work then runs once, column pruning still works, the size is known to the
    optimizer, and a lost executor costs a re-read instead of a recomputation.
    """
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
