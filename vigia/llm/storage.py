"""Where intermediate results go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder of our own, on one machine only (tests)."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nobody has used yet, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that a task reads at least of a result that was cut off, but for the last.
TASK_ROWS = 20_000


def cut(df: DataFrame, gather: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives the loss of executors.

    ``gather``: go on in as many tasks as there are rows for, as each task leaves files for each shuffle; a large result keeps its tasks.
    """
    shared_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    return df.coalesce(max(1, -(-df.count() // TASK_ROWS))) if gather else df
