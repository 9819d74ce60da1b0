"""SimHash near-duplicates by Golay-code fuzzy hashing, and connected components.

Fingerprints of 64 bits are cut into segments of 23, 23 and 18 bits. If two
fingerprints differ in at most two bits, then leaving out the segment with most
differences leaves two segments with at most one difference between them: one
is equal, the other differs in at most one bit. The equal one is taken as it
is, the other is decoded with the perfect [23, 12, 7] Golay code. The nearest
codeword of one word lies within distance four of any word one bit away, so a
word that offers all codewords within distance four as keys meets the other's
nearest codeword. Two words one bit apart have different parity, so only the
even one has to offer several keys. Keys are joined, pairs are verified.

Nulls and edge cases: a null or empty text, or one of white space only, has
fingerprint zero and links like any other; texts of one or two words have a
single shingle. Rows with equal fingerprints share a class. A null doc_id takes
part but never names a component; a component of such rows only has a null id.
Repeated rows stay as they are. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .common import checked, discard, fresh, held, written

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code.
GOLAY = 0xAE3
#: Parts into which the links of one fingerprint are dealt in a join.
SALTS = 8
#: Rows from which on a fingerprint is heavy, and heavy ones at most that are broadcast; there are no more than rows / HEAVY.
HEAVY, BROADCAST_HEAVY = 1000, 500_000


def fingerprints(texts: pa.Array) -> np.ndarray:
    """64-bit SimHash of each text's word shingles."""
    return np.concatenate([np.empty(0, np.uint64), *map(_chunk, text.chunks(texts))])


def _chunk(texts: pa.Array) -> np.ndarray:
    data, offsets = text.flat(texts)
    found, bounds = text.words(text.LOWER[data], offsets)
    if not len(found):
        return np.zeros(len(texts), np.uint64)
    ends = np.frombuffer(found.buffers()[1], np.int64)
    size = np.diff(ends)
    k = np.arange(len(size))
    joined = np.full(ends[-1] + len(size), 32, np.uint8)
    joined[np.arange(ends[-1]) + np.repeat(k, size)] = np.frombuffer(found.buffers()[2], np.uint8)
    raw = joined.tobytes()
    count = np.diff(bounds)
    n = np.where(count > 0, np.maximum(count - SHINGLE_WORDS + 1, 1), 0)
    first = text.ragged(k, bounds[:-1], n)
    last = np.minimum(first + SHINGLE_WORDS, np.repeat(bounds[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends[first] + first).tolist(), (ends[last + 1] + last).tolist(), strict=True)
    return majority(np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(first)), n)


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each group of n consecutive hashes, the bits set in over half of them.

    Eight byte counters are added at once, in blocks of at most 255 hashes.
    """
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    size = n[full]
    start = np.cumsum(size) - size
    blocks = -(-size // 255)
    at = np.repeat(start, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    of = np.cumsum(blocks) - blocks
    fp = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), at)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), of, axis=0, dtype=np.int64)
        for j in range(8):
            fp |= (2 * counts[:, j] > size).astype(np.uint64) << np.uint64(8 * j + k)
    out[full] = fp
    return out


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    out = pa.array(fingerprints(texts).view(np.int64))
    text.release()
    return out


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the nearest error pattern, then all patterns of up to four bits and where they start."""
    low = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)], np.int32)
    low = low[np.lexsort((low, np.bitwise_count(low)))]
    s = syndrome(low)
    order = np.argsort(s, kind="stable")
    patterns, starts = low[order], np.searchsorted(s[order], np.arange(2049))
    return patterns[starts[:-1]], patterns, starts


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words, as polynomials, by the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where((v >> bit) & 1, GOLAY << (bit - 11), 0).astype(v.dtype)
    return v


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (position in fps, key, whether it is the key under which the fingerprint is filed)."""
    own = held("simhash")
    if not own:
        own["golay"] = _golay()
    nearest, patterns, starts = own["golay"]
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    n = np.arange(len(fps))
    rows, found, filed = [], [], []
    for kind, (exact, fuzzy) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        a, b = parts[exact], parts[fuzzy]
        s = syndrome(b)
        head = (np.int64(kind) << 35) | (a << 12)
        rows.append(n)
        found.append(head | ((b ^ nearest[s]) >> 11))
        filed.append(np.ones(len(n), bool))
        even = np.flatnonzero(np.bitwise_count(b) % 2 == 0)
        more = (starts[s + 1] - starts[s])[even] - 1
        at = np.repeat(even, more)
        e = text.ragged(patterns, starts[s[even]] + 1, more)
        rows.append(at)
        found.append(head[at] | ((b[at] ^ e) >> 11))
        filed.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(filed)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), 5_000):
            part = fps[i : i + 5_000]
            at, key, filed = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at]), pa.array(filed)], ["key", "fp", "filed"])
        text.release()


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a < b) of the distinct values of the one column fps that differ in one or two bits, written."""
    rows = written(fps.mapInArrow(_key_rows, "key long, fp long, filed boolean"), "fuzzy-keys")
    found = written(_pairs(rows), "links")
    discard(rows)
    return found


def _pairs(rows: DataFrame) -> DataFrame:
    x, y = rows.select("key", F.col("fp").alias("x")), rows.where("filed").select("key", F.col("fp").alias("y"))
    near = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MAX_BITS)
    pairs = x.alias("l").join(y.alias("r"), (F.col("l.key") == F.col("r.key")) & near)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the least node reachable.

    Alternating large and small stars; each round is written to the shared folder.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "stars")
    before = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        large = _onto_least(both, both).where("w > m").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        small = _onto_least(large, large)
        small = small.select("u", "m").union(small.select("w", "m")).toDF("u", "v").where("u != v").distinct()
        older, edges = edges, written(small, "stars")
        discard(older)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _onto_least(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Rows (u, w, m): each edge u-w with the least of u and its neighbours; a hub's edges are dealt over several tasks."""
    least = near.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = edges.select("u", F.col("v").alias("w"), F.pmod(F.hash("v"), F.lit(SALTS)).alias("salt"))
    return dealt.join(least, ["u", "salt"]).select("u", "w", "m")


def rooted(fps: DataFrame, id_col: str, fp_col: str) -> DataFrame:
    """(fp, least, root) for each fingerprint: its least id, and the one fingerprint that stands for its component."""
    own = written(fps.groupBy(fp_col).agg(F.min(id_col).alias("least"), F.count("*").alias("rows")).toDF("fp", "least", "rows"), "fingerprints")
    pairs = links(own.select("fp"))
    tree = components(pairs)
    discard(pairs)
    return written(own.join(tree, own.fp == tree.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "rooted")


def classes(fps: DataFrame, id_col: str, fp_col: str) -> DataFrame:
    """(fp, component, rows) for each fingerprint: the least id that is reachable by links, and how many rows have it."""
    rows = rooted(fps, id_col, fp_col)
    least = rows.groupBy("root").agg(F.min("least").alias("component"))
    return written(rows.join(least, "root").select("fp", "component", "rows"), "classes")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint in hex and component id."""
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    found = classes(rows, "id", "fp").withColumnRenamed("fp", "fp2")
    same = F.col("fp") == F.col("fp2")
    heavy = found.where(F.col("rows") > HEAVY)
    if heavy.count() <= BROADCAST_HEAVY:  # a text that a third of all rows have isn't sent to one task
        often = rows.join(F.broadcast(heavy), same)
        rest = rows.join(F.broadcast(heavy), same, "left_anti")
        out = often.unionByName(rest.join(found.where(F.col("rows") <= HEAVY), same))
    else:
        out = rows.join(found, same)
    return out.select(F.col("id").alias(id_col), hexed("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with docs' columns: of its least id and, of that, the least fingerprint.

    A component whose rows all have no id gives one row as well. An id with texts of
    several components may stay in each of them.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("least").isNull(), F.col("least").alias("id"), F.col("fp").alias("fp")))
    stay = written(rooted(rows, "id", "fp").groupBy("root").agg(first.alias("s")).select(F.col("s.id").alias("stay_id"), F.col("s.fp").alias("stay_fp")), "survivors")
    key = fresh(docs, "gone_id")
    both = F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("fp") == F.col("stay_fp"))
    gone = rows.where("id is not null").join(stay, both, "left_anti").select(F.col("id").alias(key)).distinct()
    gone = checked(written(gone, "gone"))
    many = written(rows.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(key)), "repeated")
    own = docs.where(F.col(id_col).isNotNull())
    if many.isEmpty() and rows.where("id is null").isEmpty():
        return own.join(gone, F.col(id_col) == F.col(key), "left_anti")
    # the id alone tells where it has one row; of the others also the fingerprint is needed
    repeated = F.col(id_col) == F.col(key)
    once = own.join(many, repeated, "left_anti").join(gone, repeated, "left_anti")
    fp, stay_id, stay_fp = (fresh(docs, x) for x in ("own_fp", "stay_id", "stay_fp"))
    others = docs.where(F.col(id_col).isNull()).unionByName(own.join(many, repeated, "left_semi"))
    others = others.withColumn(fp, fingerprint(F.col(text_col))).dropDuplicates([id_col, fp])
    kept = others.join(stay.toDF(stay_id, stay_fp), F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(fp) == F.col(stay_fp)), "left_semi")
    return once.unionByName(kept.drop(fp))
