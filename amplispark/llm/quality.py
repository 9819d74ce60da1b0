"""Quality by perplexity under an interpolated modified Kneser-Ney model of UTF-8 byte n-grams.

The model is trained on trusted texts: those labelled of good quality, but for
an eighth of them, which are kept to set thresholds. n-grams of ORDER
bytes are counted in blocks of text, summed by key, and turned into
probabilities order by order in joins of counts with the statistics of their
contexts and the next lower order. The result is written in shards by key, each
of bounded size. Scoring looks up the distinct n-grams of a batch of texts, one
shard after the other, so neither a task nor the driver ever holds the model:
a join of all texts' n-grams with it would shuffle the texts as well.

A document is kept if its perplexity is at most a quantile of that of the
held-back trusted texts of its language.

Nulls and edge cases: a null or empty text has null perplexity and isn't kept.
A language takes its own quantile, of however many texts; a null language, or
one without any held-back text, takes the quantile of all; without any held-back text, all texts are kept. Labels with
null id or quality are ignored, and a document with contradicting labels isn't
trusted. Repeated rows stay; other columns are kept by `good`; an empty table
gives an empty result. A text of any length is scored whole, in pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .common import fresh, fresh_path, held, open_fs, written

#: Bytes of an n-gram, and bits for each: 0 is the padding before a text, a byte counts from 1.
ORDER, BITS = 6, 9
BLOCK_BYTES, CHUNK_BYTES, GROUP_BYTES = 16 << 20, 512 << 10, 8 << 20
#: n-grams in a shard, about, and in the shards that a worker keeps at once.
SHARD_ROWS, KEPT_ROWS = 400_000, 4_000_000
#: Trusted ids that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
HIGH = 0.99
#: Accuracy of the thresholds: the share of texts below is right to one part in so many.
ACCURACY = 10_000


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each byte, with padding before each text, and the n + 1 bounds."""
    data, bounds = text.flat(texts)
    points = data.astype(np.int64) + 1
    keys = points.copy()
    starts = bounds[:-1][bounds[:-1] < len(points)]
    for back in range(1, ORDER):
        earlier = np.zeros(len(points), np.int64)
        earlier[back:] = points[:-back] if len(points) > back else 0
        for k in range(back):  # the first bytes of each text have nothing before them
            at = starts + k
            earlier[at[at < len(points)]] = 0
        keys |= earlier << (BITS * back)
    return keys, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def emit() -> pa.RecordBatch:
        got = pa.table({"k": pa.chunked_array([x[0] for x in held]), "n": pa.chunked_array([x[1] for x in held])}).group_by("k").aggregate([("n", "sum")]).combine_chunks()
        return pa.RecordBatch.from_arrays([got["k"].combine_chunks(), got["n_sum"].combine_chunks()], ["key", "n"])

    for batch in batches:
        for part in text.chunks(batch.column(0), CHUNK_BYTES):
            coded = pa.array(grams(part)[0]).dictionary_encode()
            held.append((coded.dictionary, pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), pa.int64())))
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield emit()
                held, size = [], 0
    if held:
        yield emit()
    text.release()


def train(texts: DataFrame, text_col: str = "text") -> str:
    """Count, smooth and write the model of the given texts; the folder it is in."""
    rows = texts.select(F.col(text_col).alias("text")).where("text is not null and text != ''")
    counts = rows.mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("a"))
    by_order = {ORDER: written(counts, "ngrams")}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct bytes before
        by_order[n] = written(by_order[n + 1].groupBy(F.col("key").bitwiseAND((1 << (BITS * n)) - 1).alias("key")).agg(F.count("*").alias("a")), "ngrams")
    uri = fresh_path(texts.sparkSession, "kneser-ney")
    meta = {"shards": {}, "unknown": 0.0}
    lower = None
    for n in range(1, ORDER + 1):
        own = by_order[n].withColumn("context", F.shiftright("key", BITS) if n > 1 else F.lit(0).cast("long"))
        c = own.agg(*(F.count_if(F.col("a") == i) for i in (1, 2, 3, 4)), F.count("*")).first()
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        d = [min(max(i - (i + 1) * y * c[i] / c[i - 1], 0.05), i - 0.05) if c[i - 1] else 0.5 * i for i in (1, 2, 3)]
        cut = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        context = own.groupBy("context").agg(F.sum("a").alias("total"), F.sum(cut).alias("cut"))
        context = context.select(F.col("context").alias("of"), "total", (F.col("cut") / F.col("total")).alias("gamma"))
        joined = own.join(context, own.context == context.of).select("key", "context", "gamma", ((F.col("a") - cut) / F.col("total")).alias("alpha"))
        if n == 1:
            meta["unknown"] = float(1 / (c[4] + 1))
            p = joined.withColumn("p", F.col("alpha") + F.col("gamma") * meta["unknown"])
            first = context.first()
            meta["unknown"] *= float(first["gamma"]) if first else 1.0
        else:
            suffix = F.col("key").bitwiseAND((1 << (BITS * (n - 1))) - 1)
            p = joined.join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("q")), suffix == F.col("suffix"))
            p = p.withColumn("p", F.col("alpha") + F.col("gamma") * F.col("q"))
        lower = written(p.select("key", "p", "context", "gamma"), "smoothed")
        shards = max(1, -(-c[4] // SHARD_ROWS))
        meta["shards"][str(n)] = shards
        for kind, table in (("p", lower.select("key", F.log("p").cast("float").alias("value"))), ("g", lower.select(F.col("context").alias("key"), F.log("gamma").cast("float").alias("value")).distinct())):
            table.withColumn("shard", F.pmod("key", F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(f"{uri}/{kind}{n}")
    where, path = open_fs(uri)
    with where.open_output_stream(f"{path}/meta.json") as f:
        f.write(json.dumps(meta).encode())
    return uri


class Model:
    """A written model; shards are read when needed, and the oldest go when too many are held."""

    def __init__(self, uri: str):
        self.where, self.path = open_fs(uri)
        with self.where.open_input_stream(f"{self.path}/meta.json") as f:
            self.meta = json.loads(f.read())
        self.held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, kind: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.held.pop((kind, shard), None)
        if got is None:
            while sum(len(x[0]) for x in self.held.values()) > KEPT_ROWS:
                self.held.pop(next(iter(self.held)))
            folder = f"{self.path}/{kind}/shard={shard}"
            try:
                names = sorted(x.path for x in self.where.get_file_info(_selector(folder)) if x.path.endswith(".parquet"))
            except FileNotFoundError:
                names = []
            tables = [pq.read_table(self.where.open_input_file(x), columns=["key", "value"]) for x in names]
            key = np.concatenate([np.zeros(0, np.int64), *(t["key"].to_numpy() for t in tables)])
            value = np.concatenate([np.zeros(0, np.float32), *(t["value"].to_numpy() for t in tables)])
            order = np.argsort(key, kind="stable")
            got = key[order], value[order]
        self.held[kind, shard] = got
        return got

    def find(self, kind: str, n: int, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, NaN where there is none."""
        out = np.full(len(keys), np.nan)
        shards = self.meta["shards"][str(n)]
        of = keys % shards
        for s in range(shards):
            at = np.flatnonzero(of == s) if shards > 1 else np.arange(len(keys))
            if not len(at):
                continue
            key, value = self.shard(f"{kind}{n}", s)
            if len(key):
                i = np.minimum(np.searchsorted(key, keys[at]), len(key) - 1)
                out[at] = np.where(key[i] == keys[at], value[i], np.nan)
        return out

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last byte after the others, backing off where needed."""
        out, back = np.full(len(keys), np.nan), np.zeros(len(keys))
        left = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            own = keys[left] & ((1 << (BITS * n)) - 1)
            p = self.find("p", n, own)
            hit = ~np.isnan(p)
            out[left[hit]] = back[left[hit]] + p[hit]
            left, own = left[~hit], own[~hit]
            if not len(left):
                break
            if n > 1:
                back[left] += np.nan_to_num(self.find("g", n, own >> BITS))
        out[left] = back[left] + np.log(self.meta["unknown"] or 1e-9)
        return out


def _selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder)


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, keys, bounds) of consecutive texts of about CHUNK_BYTES; a longer text comes in several pieces, with bounds as in one."""
    at = 0
    for part in text.chunks(texts, CHUNK_BYTES):
        keys, bounds = grams(part)
        for i in range(0, max(len(keys), 1), 2 * CHUNK_BYTES):
            yield at, keys[i : i + 2 * CHUNK_BYTES], np.clip(bounds - i, 0, min(2 * CHUNK_BYTES, len(keys) - i))
        at += len(part)


def perplexities(texts: pa.Array, model: Model) -> np.ndarray:
    """Perplexity by byte of each text, NaN if it is empty.

    The distinct n-grams of about GROUP_BYTES are looked up together and in order.
    """
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    held, size = [], 0

    def add() -> None:
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in held)]))
        logs = model.log_p(known)
        for at, keys, codes, bounds in held:
            own = logs[np.searchsorted(known, keys)]
            total[at : at + len(bounds) - 1] += text.sums(own[codes], bounds)
            n[at : at + len(bounds) - 1] += np.diff(bounds)
        held.clear()

    for at, keys, bounds in pieces(texts):
        coded = pa.array(keys).dictionary_encode()
        held.append((at, coded.dictionary.to_numpy(), coded.indices.to_numpy(), bounds))
        size += len(keys)
        if size >= GROUP_BYTES:
            add()
            size = 0
    add()
    return np.where(n > 0, np.exp(-total / np.maximum(n, 1)), np.nan)


def scorer(uri: str):
    """A UDF of a text: its perplexity by byte, null if it is empty."""

    @F.arrow_udf("double")
    def perplexity(texts: pa.Array) -> pa.Array:
        own = held("quality")
        if uri not in own:
            own.clear()
            own[uri] = Model(uri)
        got = perplexities(texts, own[uri])
        text.release()
        return pa.array(got, mask=np.isnan(got))

    return perplexity


def trusted(docs: DataFrame, labels: DataFrame, id_col: str, held: bool) -> DataFrame:
    """Rows of docs whose labels all say good quality: those held back for thresholds, or the others."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    good = good.where((F.crc32(F.col("doc_id").cast("string")) % 8 == 0) == held).select(F.col("doc_id").alias("trusted_id"))
    good = written(good, "trusted")
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return docs.join(good, F.col(id_col) == F.col("trusted_id"), "left_semi")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, Column, Column, Column]:
    """docs with a perplexity column more, and expressions of that, of the threshold and of whether to keep."""
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    perplexity = scorer(train(trusted(few, labels, "id", False)))
    held = written(trusted(few, labels, "id", True).select("lang", perplexity("text").alias("ppl")), "held").where("ppl is not null")  # a filter before writing would be pushed below the join, and score all texts
    q = lambda p: F.percentile_approx("ppl", p, ACCURACY)
    overall = held.agg(q(HIGH)).first()[0]
    of_lang = held.where("lang is not null").groupBy("lang").agg(q(HIGH).alias("high")).collect()
    name = fresh(docs, "perplexity")
    scored = docs.withColumn(name, perplexity(F.col(text_col)))
    high = F.lit(overall).cast("double")
    for r in of_lang:
        high = F.when(F.col(lang_col) == r["lang"], r["high"]).otherwise(high)
    ppl = F.col(name)
    keep = F.coalesce(ppl.isNotNull() & (high.isNull() | (ppl <= high)), F.lit(False))
    return scored, ppl, high, keep


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, perplexity, threshold and keep of every row."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    scored, ppl, high, keep = judged(few, labels, "doc_id", "text", "lang")
    return scored.select("doc_id", "lang", ppl.alias("perplexity"), high.alias("threshold"), keep.alias("keep"))


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs to keep, with docs' columns."""
    scored, _, _, keep = judged(docs, labels, id_col, text_col, lang_col)
    return scored.where(keep).select(*[F.col(f"`{c}`") for c in docs.columns])
