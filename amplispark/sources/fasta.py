"""FASTA as DataFrames: a Python data source for whole records, chunks, and a stream of arriving files.

The data source opens each file once where it is planned: compression is told by
a file's first two bytes, or by its suffix. Plain files are split; a record
belongs to the split in which its mark stands, and text before a file's first
mark belongs to none. Lines are trimmed, a-z become capitals, and the id is the
header up to the first space or tab; a record without an id is left out.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.alphabet import slices

SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 4 << 20, 8 << 20
SCHEMA = "source_file string, record string, seq string"


def parsed(body: bytes) -> tuple[str, bytes] | None:
    """Id and bases of the text from behind a record's mark up to the next one's."""
    header, _, lines = body.partition(b"\n")
    name = re.split(rb"[ \t]", header.rstrip(b"\r"), maxsplit=1)[0].decode("utf-8", "replace")
    return (name, b"".join(x.strip(b" \t\r") for x in lines.split(b"\n")).upper()) if name else None


def bodies(read, start: int, end: int | None) -> Iterator[bytes]:
    """Texts behind the marks that stand from start to before end; read gives the next bytes from start on, b"" at the end.

    A mark is a > at the beginning of the file or of a line. Where start is not 0,
    the byte before it comes first.
    """
    held, at, first = b"", start - (start > 0), True
    inside, parts, done = False, [], False
    while not done:
        data = read(READ_BYTES)
        done = not data
        held += data
        if first and start == 0 and held[:1] == b">":
            inside, held, at = True, held[1:], 1
        if held:
            first = False
        while True:
            mark = held.find(b"\n>")
            if mark < 0:
                break
            if inside:
                yield b"".join([*parts, held[:mark]])
            parts, place = [], at + mark + 1
            if end is not None and place >= end:
                return
            inside, held, at = True, held[mark + 2 :], at + mark + 2
        keep = 0 if done else 1  # a line feed at the end may be a mark's
        if inside:
            parts.append(held[: len(held) - keep])
        at += len(held) - keep
        held = held[len(held) - keep :] if keep else b""
    if inside:
        yield b"".join(parts)


class FastaSplit(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, compressed: bool):
        self.path, self.start, self.end, self.compressed = path, start, end, compressed


class FastaReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    @staticmethod
    def opened(path: str):
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path)
        return where.open_input_file(name)

    def partitions(self):
        splits = []
        for path in self.paths:
            with self.opened(path) as f:
                size, compressed = f.size(), f.read(2) == b"\x1f\x8b" or path.endswith(".gz")
            if compressed:
                splits.append(FastaSplit(path, 0, None, True))
            else:
                splits += [FastaSplit(path, at, min(at + SPLIT_BYTES, size), False) for at in range(0, size, SPLIT_BYTES)]
        return splits or [FastaSplit("", 0, 0, False)]

    def read(self, partition):
        import gzip

        import pyarrow as pa

        if not partition.path:
            return
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["source_file", "record", "seq"])
        with self.opened(partition.path) as raw:
            f = gzip.GzipFile(fileobj=raw) if partition.compressed else raw
            if partition.start:
                f.seek(partition.start - 1)
            for body in bodies(f.read, partition.start, partition.end):
                got = parsed(body)
                if got:
                    rows.append((got[0], got[1].decode("utf-8", "replace")))
                    size += len(got[1])
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class FastaSource(DataSource):
    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastaReader(json.loads(self.options["files"]))


def expanded(spark: SparkSession, path: str) -> list[str]:
    """URIs of the files that a path, folder or pattern stands for; an error if there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = where.globStatus(hadoop) or []
    out = []
    for x in found:
        inner = where.listStatus(x.getPath()) if x.isDirectory() else [x]
        out += [(y.getPath().toUri().toString()) for y in inner if not y.isDirectory() and y.getPath().getName()[0] not in "._"]
    if not out:
        raise FileNotFoundError(path)
    return sorted(re.sub("^file:/+", "file:///", x) for x in out)


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(source_file, record, seq) of files, folders, patterns, or of the standard input if a path is `-`."""
    files = [x for p in paths if p != "-" for x in expanded(spark, p)]
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FastaSource)
    rows = spark.read.format("fasta").option("files", json.dumps(files)).load()
    if "-" in paths:
        found = map(parsed, bodies(sys.stdin.buffer.read, 0, None))
        rows = rows.unionByName(spark.createDataFrame([("-", x[0], x[1].decode()) for x in found if x], SCHEMA))
    return rows


def _parsed(lines: DataFrame) -> DataFrame:
    """(source_file, record, seq) from texts between record marks; compression goes by suffix."""
    value = F.col("value")
    header = F.regexp_extract(F.regexp_replace(value, "^>", ""), r"^([^\r\n]*)", 1)
    body = F.regexp_replace(value, r"^[^\n]*\n?", "")
    seq = F.upper(F.regexp_replace(F.regexp_replace(body, r"(?m)^[ \t\r]+|[ \t\r]+$", ""), "\n", ""))
    rows = lines.select(F.input_file_name().alias("source_file"), F.regexp_extract(header, r"^([^ \t]*)", 1).alias("record"), seq.alias("seq"))
    return rows.where("record != ''")


def read_fasta_text(spark: SparkSession, *paths: str) -> DataFrame:
    """The same by Spark's text source, for stores that only Spark reads. Files have to begin with a mark."""
    return _parsed(spark.read.option("lineSep", "\n>").text(list(paths)))


def stream_fasta(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The same, by the text source, for files as they arrive in a folder."""
    return _parsed(spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder))


def chunks(records: DataFrame, size: int, overlap: int) -> DataFrame:
    """(record, at, seq): overlapping pieces of at most size bases; none begins once the end is reached."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be smaller than the size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.octet_length("seq") - size) / step).cast("int")) * step
    rows = records.select("record", F.inline(slices(F.col("seq"), F.sequence(F.lit(0), last, F.lit(step)), size)))
    return rows.select("record", "at", F.col("seq").cast("string").alias("seq"))


def wrapped_chunks(records: DataFrame, size: int, circular: bool = True) -> DataFrame:
    """(record, at, seq, is_wrap, is_last): consecutive pieces of size bases; on a circle a last one of the record's last size bases, and is_wrap.

    A record of at most size bases, or with size 0, is one piece.
    """
    n = F.octet_length("seq")
    whole = records.where(F.lit(size <= 0) | (n <= size))
    one = whole.select("record", F.lit(0).alias("at"), "seq", F.lit(False).alias("is_wrap"), F.lit(True).alias("is_last"))
    if size <= 0:
        return one
    rows = records.where(n > size).select("record", n.alias("n"), F.inline(slices(F.col("seq"), F.sequence(F.lit(0), n - 1, F.lit(size)), size)))
    rows = rows.select("record", "at", F.col("seq").cast("string").alias("seq"), F.lit(False).alias("is_wrap"), (F.lit(not circular) & (F.col("at") + size >= F.col("n"))).alias("is_last"))
    out = one.unionByName(rows)
    if circular:
        out = out.unionByName(records.where(n > size).select("record", (n - size).alias("at"), F.right("seq", F.lit(size)).alias("seq"), F.lit(True).alias("is_wrap"), F.lit(True).alias("is_last")))
    return out


def chunk_policy(size: int, longest: int, longest_primer: int, circular: bool = False) -> tuple[int, int, str]:
    """(size, overlap, why not) of chunks in which no amplicon is lost: (0, 0, reason) where records have to stay whole."""
    if size <= 0:
        return 0, 0, ""
    if circular:
        return 0, 0, "circular records stay whole"
    if longest <= 0:
        return 0, 0, "without a longest amplicon no overlap is safe"
    if size <= longest:
        return 0, 0, f"chunks of {size} are no longer than the longest amplicon, {longest}"
    return size, longest if longest > 0 else max(longest_primer - 1, 0), ""


def chunk_id(record: Column, at: Column, seq: Column) -> Column:
    return F.concat(record, F.lit(":"), at.cast("string"), F.lit("-"), (at + F.length(seq)).cast("string"))


def split_chunk_id(name: Column) -> tuple[Column, Column]:
    """Base id and offset of `id:start-end`; other ids have offset 0."""
    shaped = name.rlike(r":\d+-\d+$")
    return F.when(shaped, F.regexp_extract(name, r"^(.*):\d+-\d+$", 1)).otherwise(name), F.when(shaped, F.regexp_extract(name, r":(\d+)-\d+$", 1).cast("long")).otherwise(F.lit(0).cast("long"))
