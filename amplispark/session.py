"""Session helpers shared by all queries."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Bounds of Arrow batches that are set where the session has Spark's defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
DEFAULT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20)}
#: Rows of a table built on the driver that is broadcast at most.
BROADCAST_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The zip is served by the driver through addPyFile, so no shared folder is
    needed and replacement executors fetch it as well.
    """
    # whole texts go to Python: bound what a batch holds, unless the session's owner has done so
    for key, value in BATCHES.items():
        if spark.conf.get(key) == DEFAULT_BATCHES[key]:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="amplispark-"), "amplispark_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer parts than there are, as small single files do; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, to be broadcast unless those are too many."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share, or the folder of setCheckpointDir; on a local master a new one if both are unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="amplispark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
