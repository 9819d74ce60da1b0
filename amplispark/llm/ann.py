"""Nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard
transform. Each table files a vector, less the mean and made a unit vector,
under the signed axis nearest to its rotation; a query looks under the PROBES
nearest axes of each table. What it finds there is compared block against block
in numpy, so no pair becomes a row but those that may be among a query's k
nearest: the tables hold vectors rounded to bytes, with a bound of the rounding
error, which gives a lower and an upper bound of each distance. Candidates whose
lower bound is above the k-th upper bound go; the rest meet the original
vectors, each of which is shuffled once, and are ranked by their exact distance
in double precision. Axes that hold many vectors are split into blocks of about
BLOCK_ROWS, and so are the queries that look there, whatever share of the rows
is alike; none is dropped. Counts by axis have 2 * dimensions * tables rows; they
are broadcast where that is at most BROADCAST_AXES.

Nulls and edge cases: vectors that are null, zero, or hold a null or
non-finite component take no part, nor does a null id. Vectors of different
lengths are not compared. A query's own id is no candidate; rows that agree in
id count once, with the nearest of their vectors. Components of any size are
compared, whatever their distance from the origin. Ties go to the smaller id.
With fewer candidates than k, or in an empty table, there are fewer rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .common import written

K, TABLES, PROBES = 10, 16, 6
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
BROADCAST_AXES = 200_000
SEED = 20
EPS = float(np.finfo(np.float64).eps)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotations of the rows, padded to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        out *= s
        h = 1
        while h < d:
            y = out.reshape(len(x), -1, 2, h)
            out = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), d)
            h *= 2
        out /= np.sqrt(d)
    return out


def axes(x: np.ndarray, table: int, n: int) -> np.ndarray:
    """The n nearest signed axes of each row's rotation, nearest first: 2 * axis + (1 if negative)."""
    y = rotated(x, table)
    both = np.stack([y, -y], 2).reshape(len(x), -1)
    n = min(n, both.shape[1])
    best = np.argpartition(-both, n - 1, axis=1)[:, :n]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, 1), axis=1, kind="stable"), 1)


def rounded(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x less centre, and its codes: for each row the step, a bound of the error of step * bytes, and the bytes."""
    y = x - centre
    step = np.maximum(np.abs(y).max(1) / 127, np.finfo(np.float64).tiny)
    code = np.rint(y / step[:, None]).astype(np.int8)
    off = np.abs(y - code * step[:, None]) + 4 * EPS * (np.abs(x) + np.abs(centre))
    most = np.maximum(off.max(1), np.finfo(np.float64).tiny)
    error = most * np.sqrt(((off / most[:, None]) ** 2).sum(1)) * (1 + 1e-9)
    raw = np.concatenate([np.stack([step, error], 1).view(np.int8), code], 1)
    return y, raw


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors by their length."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        lists = batch.column(0)
        size = lists.value_lengths().to_numpy()
        for d in np.unique(size):
            x = _matrix(lists.take(pa.array(np.flatnonzero(size == d))), d)
            own = sums.setdefault(int(d), np.zeros(d + 1))
            with np.errstate(over="ignore"):
                own[:d] += x.sum(0)
            own[d] += len(x)
    for d, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(own)], ["d", "i", "s"])


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the vectors of each length; zero where it isn't finite."""
    got: dict[int, np.ndarray] = {}
    for r in rows.select("v").mapInArrow(_sums, "d int, i int, s double").groupBy("d", "i").agg(F.sum("s").alias("s")).collect():
        got.setdefault(r["d"], np.zeros(r["d"] + 1))[r["i"]] = r["s"]
    return {d: np.nan_to_num(s[:d] / s[d], posinf=0.0, neginf=0.0) for d, s in got.items()}


def _filed(n: int, centre: dict[int, np.ndarray]):
    """Rows (d, id, code, keys): keys are the n nearest axes in each table, the tables' axes numbered on end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            size = lists.value_lengths().to_numpy()
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                y, raw = rounded(_matrix(lists.take(pa.array(rows)), d), centre[int(d)])
                unit = y / np.maximum(np.abs(y).max(1, keepdims=True), np.finfo(np.float64).tiny)
                unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), np.finfo(np.float64).tiny)
                width = 2 * (1 << max(1, (int(d) - 1).bit_length()))
                keys = np.concatenate([axes(unit, t, n) + width * t for t in range(TABLES)], 1).astype(np.int32)
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
                lists_of = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d, np.int32)), ids.take(pa.array(rows)), code, lists_of], ["d", "id", "code", "keys"])
        text.release()

    return run


def bounds(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all coded queries and vectors."""
    (sq, eq, cq), (sv, ev, cv) = ((r[:, :8].copy().view("<f8")[:, 0], r[:, 8:16].copy().view("<f8")[:, 0], r[:, 16:].astype(np.float64)) for r in (q.view(np.int8), v.view(np.int8)))
    unit = max(sq.max(), sv.max()) * 127  # no square overflows, and what vanishes is far below the errors
    x, y = cq * (sq / unit)[:, None], cv * (sv / unit)[:, None]
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)[None]
    square = xx + yy - 2 * x @ y.T
    slack = 8 * x.shape[1] * EPS * (xx + yy) + 1e-300
    error = eq[:, None] + ev[None]
    low = np.sqrt(np.maximum(square - slack, 0)) * unit * (1 - 1e-12) - error
    return low, np.sqrt(np.maximum(square, 0) + slack) * unit * (1 + 1e-12) + error


def _near(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: queries, right: vectors of one block. Those of the block that may be among a query's k nearest."""
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        if left.num_rows and right.num_rows:
            q, v = (np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(t.num_rows, -1) for t in (left, right))
            qid, vid = left["id"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(vid, kind="stable")
            v, vid = v[order], vid[order]
            low, high = bounds(q, v)
            first = np.flatnonzero(np.append(True, vid[1:] != vid[:-1]))
            if len(first) < len(vid):
                low, high, vid = np.minimum.reduceat(low, first, axis=1), np.minimum.reduceat(high, first, axis=1), vid[first]
            own = qid[:, None] == vid[None]
            high[own] = low[own] = np.inf
            n = min(k, len(vid))
            most = np.partition(high, n - 1, axis=1)[:, n - 1]
            at = np.nonzero((low <= most[:, None]) & ~own)
            out = [qid[at[0]], vid[at[1]], low[at], high[at]]
        return pa.table(out, names=["query_id", "vec_id", "low", "high"])

    return run


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, scaled where squares would overflow or vanish."""
    apart = F.zip_with(a, b, lambda x, y: x - y)
    total = lambda xs, unit: F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x / unit) * (x / unit))
    plain, most = total(apart, F.lit(1.0)), F.array_max(F.transform(apart, F.abs))
    fine = ((plain > 1e-280) & (plain < 1e300)) | (most == 0)
    return F.when(fine, F.sqrt(plain)).otherwise(most * F.sqrt(total(apart, most)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row of queries."""
    every_v, every_q = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    centre, schema = centres(every_v.unionByName(every_q)), "d int, id long, code binary, keys array<int>"
    filed = [written(rows.mapInArrow(_filed(n, centre), schema), name) for rows, n, name in ((every_v, 1, "ann-index"), (every_q, PROBES, "ann-probes"))]
    index, probes = (rows.select("d", F.explode("keys").alias("key"), "id", "code") for rows in filed)
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    held = index.groupBy("d", "key").agg(F.count("*").alias("held"))
    asked = probes.groupBy("d", "key").agg(F.count("*").alias("asked"))
    size = written(held.join(asked, ["d", "key"]).select("d", "key", parts("held", BLOCK_ROWS).alias("blocks"), parts("asked", BLOCK_QUERIES).alias("groups")), "ann-axes")
    if size.count() <= BROADCAST_AXES:
        size = F.broadcast(size)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    right = index.join(size, ["d", "key"]).withColumn("block", dealt("blocks")).withColumn("part", every("groups"))
    left = probes.join(size, ["d", "key"]).withColumn("part", dealt("groups")).withColumn("block", every("blocks"))
    on, cols = ["d", "key", "block", "part"], ["d", "key", "block", "part", "id", "code"]
    found = left.select(cols).groupBy(on).cogroup(right.select(cols).groupBy(on)).applyInArrow(_near(k), "query_id long, vec_id long, low double, high double")
    found = written(found.groupBy("query_id", "vec_id").agg(F.min("low").alias("low"), F.min("high").alias("high")), "ann-candidates")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("high"))
    limit = found.select("query_id", "high", first.alias("n")).where(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.max("high")).alias("most"))
    left_over = found.join(limit, "query_id").where(F.col("most").isNull() | (F.col("low") <= F.col("most"))).select("query_id", "vec_id")
    both = left_over.join(every_q.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").join(every_v.withColumnRenamed("id", "vec_id"), "vec_id")
    exact = both.where(F.size("q") == F.size("v")).select("query_id", "vec_id", distance(F.col("q"), F.col("v")).alias("score"))
    best = exact.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
