"""Intermediate tables in the shared folder, workers' caches and column names for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Lost executors cost nothing here, as the files outlive them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.shared_path = path
    return got


#: Rows of a written table of ids that is broadcast at most.
BROADCAST_IDS = 500_000


def checked(df: DataFrame) -> DataFrame:
    """A table of ids that written() made, to be broadcast unless it has more than BROADCAST_IDS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def discard(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing that is still to be computed reads it."""
    path = getattr(df, "shared_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What a worker keeps between batches for one operator; that of all others goes, as workers live on from stage to stage."""
    for name in [n for n in _held if n != owner]:
        del _held[name]
    return _held.setdefault(owner, {})


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, for workers that read or write shared files themselves."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
