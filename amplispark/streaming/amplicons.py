"""Amplicons of FASTA files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.panel import Pair
from ..operators.products import amplicons, deduplicated
from ..session import ship
from ..sources.fasta import split_chunk_id, stream_fasta

#: What makes an amplicon one that was seen, whichever file it came in.
SEEN = ("sequence_id", "pair_ord", "start", "end", "type", "is_wrap")


def amplicons_of(records: DataFrame, pairs: list[Pair], max_mm: int = 0, window: int = 0, min_length: int = 0, max_length: int = 2000, circular: bool = False) -> DataFrame:
    """Amplicons of one batch of (source_file, record, seq); ids may repeat between files, not within one."""
    key = F.concat_ws("\t", "source_file", "record")
    found = amplicons(records.select(key.alias("record"), "seq"), pairs, max_mm, window, min_length, max_length, circular)
    parts = F.split("record", "\t", 2)
    return found.withColumns({"source_file": parts[0], "sequence_id": parts[1]}).drop("record")


def in_whole_records(rows: DataFrame) -> DataFrame:
    """Amplicons of pieces named `id:start-end` under their record's id and in its coordinates."""
    base, at = split_chunk_id(F.col("sequence_id"))
    return rows.withColumns({"sequence_id": base, "start": F.col("start") + at, "end": F.col("end") + at})


def not_seen(rows: DataFrame, out: str, batch: int) -> DataFrame:
    """rows without those that an earlier batch has written: the output itself is the state, so it is neither bounded nor lost."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return rows
    before = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(out).where(F.col("batch") < batch)
    return rows.join(before.select(*SEEN), list(SEEN), "left_anti").select(*rows.columns)


def stream_amplicons(spark: SparkSession, folder: str, pairs: list[Pair], out: str, checkpoint: str, files_per_batch: int = 100, pieces: bool = False, **options) -> StreamingQuery:
    """A query that takes all files now in the folder and ends; started again, it takes only what came since.

    A record is whole within its file, so each batch is complete by itself and
    no state is kept. A batch is written to its own folder `batch=<n>` under out,
    which a repeated batch overwrites: each amplicon is there once, also after a failure.

    With pieces the records are overlapping pieces of longer ones, whose files may
    arrive apart: amplicons get their record's coordinates, and one that an
    earlier batch has found in another piece is left out.
    """
    ship(spark)

    def write(records: DataFrame, n: int) -> None:
        rows = amplicons_of(records, pairs, **options)
        if pieces:
            rows = in_whole_records(rows)
            rows = not_seen(deduplicated(rows.withColumn("record", F.col("sequence_id")).drop("source_file")).drop("record"), out, n)
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = stream_fasta(spark, folder, files_per_batch)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
