"""WARC archives, written and read by a Python data source.

Each record is a gzip member of its own that carries its length in the "sl"
(skip-lengths) field of the member's header. A reader inflates only as much as
the record's header takes, and goes on behind a record that isn't wanted without
reading or inflating the rest. Files can be split: a split begins at the first
member behind its start. Tasks write under names of their own, and a manifest
made when all are done names those that count, so what a lost or repeated task
wrote is never read.

The source plans partitions of at most SPLIT_BYTES, takes predicates on
record_type, page_id and target_uri, and skips the payloads of all records if
the option payload is false. Archives of other writers (plain, or gzip without
skip lengths) are read from end to end, one partition a file.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the
largest page_id is a response and the others are revisits of it. Which page
that is comes from digests alone; those that occur once are none. Up to
BROADCAST_DIGESTS repeated digests are broadcast, so that no page is shuffled;
more are joined by a shuffle, where Spark splits a digest that many pages share.

Nulls and edge cases: null html is an empty payload, a null url has no header.
A null page_id is never referred to: such a page revisits a page with an id, or
is a response if no page of its payload has one. Repeated rows that hold the
largest page_id are all responses. Other columns are ignored; an empty table
gives empty archives and an empty result. A payload of any length is one record.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
import zlib
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import fresh_path, written

MIN_REVISIT = 1000
BROADCAST_DIGESTS = 500_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value: the profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES, SPLIT_BYTES, PEEK = 4 << 20, 64 << 20, 2048
MANIFEST = "_manifest.json"
#: Fixed value: how a gzip member with skip lengths begins (flag FEXTRA), and the field's head at offset 10.
MEMBER, FIELD = b"\x1f\x8b\x08\x04", b"\x0c\x00sl\x08\x00"
NAMES = ("record_type", "page_id", "target_uri", "refers_to", "payload_digest", "payload_length", "payload")


def referred(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url and payload as they come, digest, refers_to): refers_to is null for responses."""
    own = pages.withColumn("payload", F.coalesce(html_col, F.lit(""))).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = own.where(F.octet_length("payload") >= MIN_REVISIT)
    top = large.groupBy("digest").agg(F.max(id_col).alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    top = written(top.select(F.col("digest").alias("top_digest"), "top"), "repeated-digests")
    if top.count() <= BROADCAST_DIGESTS:
        top = F.broadcast(top)
    both = own.join(top, (F.col("digest") == F.col("top_digest")) & (F.octet_length("payload") >= MIN_REVISIT), "left")
    return both.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("top")), F.col("top")))


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record with its last two line ends."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": None if page is None else f"<urn:page:{page}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member with skip lengths (0 where 32 bits don't hold them, as for readers that don't know the field)."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 14 + len(body) + 8
    lengths = struct.pack("<II", size, len(data)) if max(size, len(data)) < 1 << 32 else bytes(8)
    return MEMBER + bytes(5) + b"\xff" + FIELD + lengths + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """A file for each task that has rows: (page_id, url, payload, digest, refers_to)."""

    def __init__(self, path: str, date: str, compression: str):
        self.path, self.date, self.compression = path, date, compression

    def write(self, iterator):
        where, folder = _fs(self.path)
        name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.compression == "gzip" else "")
        out = None
        for batch in iterator:
            for page, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    where.create_dir(folder)
                    out = where.open_output_stream(f"{folder}/{name}", compression=None)
                data = record(page, url, payload.encode(), digest, refers_to, self.date)
                out.write(member(data) if self.compression == "gzip" else data)
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages):
        where, folder = _fs(self.path)
        where.create_dir(folder)
        names = sorted(m.name for m in messages if m and m.name)
        with where.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        where, folder = _fs(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{folder}/{m.name}")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write a record for every row, each as a gzip member, or plain with compression none. A null page_id leaves the record id out."""
    rows = referred(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)), id_col, html_col)
    rows = rows.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), "payload", "digest", F.col("refers_to").cast("long").alias("refers_to"))
    registered(pages.sparkSession)
    rows.write.format("warc").mode("append").option("date", date).option("compression", compression).save(path)


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}
        #: Bytes inflated and records passed over, for those who want to see what was skipped.
        self.inflated = self.skipped = 0

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in ("record_type", "page_id", "target_uri"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        where, path = _fs(self.path)
        own = where.get_file_info(f"{path}/{MANIFEST}")
        if own.type == fs.FileType.File:
            with where.open_input_stream(own.path) as f:
                found = where.get_file_info([f"{path}/{x}" for x in json.loads(f.read())])
        else:
            found = where.get_file_info(fs.FileSelector(path, recursive=True))
            found = [x for x in found if x.type == fs.FileType.File and x.size and x.base_name[0] not in "._"]
        splits = []
        for x in sorted(found, key=lambda x: x.path):
            step = SPLIT_BYTES if own.type == fs.FileType.File and x.path.endswith(".gz") else x.size
            splits += [Split(x.path, at, min(at + step, x.size)) for at in range(0, x.size, step)]
        return splits or [Split("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        rows, size = [], 0
        if not partition.path:
            return
        for row in self.records(partition):
            rows.append(row)
            size += len(row[-1] or b"")
            if size >= BATCH_BYTES or len(rows) >= 4000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], NAMES)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], NAMES)

    def records(self, split: Split):
        import io

        where, _ = _fs(self.path)
        with where.open_input_file(split.path) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            begins = f.peek(16)[:16]
            if begins[:4] == MEMBER and begins[10:16] == FIELD:
                yield from self.members(f, split)
            else:
                yield from self.stream(f, split.path, begins[:2] == b"\x1f\x8b")

    def head(self, text: bytes) -> tuple[dict, list | None]:
        """Headers of a record, and the columns before the payload unless the record isn't wanted."""
        page = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x else None
        head = {}
        for line in text.split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip()
        row = {"record_type": head.get("warc-type"), "page_id": page(head.get("warc-record-id")), "target_uri": head.get("warc-target-uri")}
        if any(row[k] not in v for k, v in self.wanted.items()):
            return head, None
        n = head.get("x-payload-length")
        return head, [*row.values(), page(head.get("warc-refers-to")), head.get("warc-payload-digest", "").removeprefix("sha1:"), int(n) if n else None]

    def wants_payload(self, row: list) -> bool:
        return self.payload and row[0] == "response"

    def members(self, f, split: Split):
        """Records whose members begin in the split."""
        at = self.first_member(f, split.start)
        while at is not None and at < split.end:
            f.seek(at)
            data = f.read(PEEK)
            if not data:
                return
            size = struct.unpack("<I", data[16:20])[0]
            z = zlib.decompressobj(31)
            text = z.decompress(data, PEEK)
            while (cut := text.find(b"\r\n\r\n")) < 0:
                text += z.decompress(z.unconsumed_tail or f.read(PEEK), PEEK)
            head, row = self.head(text[:cut])
            if row is not None and self.wants_payload(row):
                parts = [text]
                while not z.eof:
                    parts.append(z.decompress(z.unconsumed_tail or f.read(max(PEEK, min(size, 1 << 20)))))
                text = b"".join(parts)
                row.append(self.body(text[cut + 4 : cut + 4 + int(head["content-length"])]))
            elif row is not None:
                row.append(None)
            self.inflated += len(text)
            if row is None:
                self.skipped += 1
            else:
                yield tuple(row)
            if size:
                at += size
                continue
            while not z.eof:  # too long for the field: its end is found by inflating it
                z.decompress(z.unconsumed_tail or f.read(1 << 20), 1 << 20)
            at = f.tell() - len(z.unused_data)

    @staticmethod
    def first_member(f, start: int) -> int | None:
        """Where the first member at or after start begins."""
        at, data = start, b""
        f.seek(start)
        while True:
            found = data.find(MEMBER)
            while found >= 0 and len(data) >= found + 64:
                try:
                    begins = data[found + 10 : found + 16] == FIELD and zlib.decompressobj(31).decompress(data[found:], 5) == b"WARC/"
                except zlib.error:
                    begins = False
                if begins:
                    return at + found
                found = data.find(MEMBER, found + 1)
            more = f.read(1 << 16)
            if not more:
                return None
            keep = data[found:] if found >= 0 else data[-15:]
            at += len(data) - len(keep)
            data = keep + more

    @staticmethod
    def body(block: bytes) -> bytes:
        return block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block

    def stream(self, f, path: str, compressed: bool):
        """Records of a file without skip lengths, from end to end."""
        import gzip
        import io

        if compressed:
            f = io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20)
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError(f"no record begins here in {path}: {line[:60]!r}")
                continue
            text = line
            while (line := f.readline()).strip():
                text += line
            head, row = self.head(text.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n").rstrip())
            length = int(head["content-length"])
            if row is None or not self.wants_payload(row):
                f.seek(length, 1)
                self.skipped += row is None
            if row is not None:
                row.append(self.body(f.read(length)) if self.wants_payload(row) else None)
                yield tuple(row)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return "record_type string, page_id long, target_uri string, refers_to long, payload_digest string, payload_length long, payload binary"

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options["date"], self.options["compression"])


def registered(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records; predicates are pushed down, for which the session's setting for that is turned on."""
    registered(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives, read them back, and return page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    got = read_warc(pages.sparkSession, path)
    whole = F.col("payload").isNotNull()
    size = F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length"))
    digest = F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest"))
    return got.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
with p as (select page_id, url, encode(coalesce(html, '')) as h from pages),
top as (select h, max(page_id) as top from p where octet_length(h) >= 1000 group by h)
select p.page_id, cast(octet_length(p.h) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
  case when top.top is not null and p.page_id is distinct from top.top then 'revisit' else 'response' end as record_type,
  case when p.page_id is distinct from top.top then top.top end as refers_to
from p left join top using (h)
"""
