"""Internal probes and nested amplicons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import MASK, normalized, reverse_complement
from ..functions.batched import distinct_rows
from .hits import GENOME, parts
from .panel import Pair
from .products import block_amplicons


#: Bases that are compared with a probe at once; a longer amplicon is taken whole.
PROBE_BASES = 1 << 20
PROBE_SCHEMA = "mm int, pos int, strand string, site string"


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of consecutive rows of about PROBE_BASES."""
    ends, start = np.cumsum(size), 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + PROBE_BASES, "right")))
        yield start, stop
        start = stop


def _best_places(texts: list[bytes], probe: str, max_mm: int) -> list[tuple[int, int, int] | None]:
    """(mismatches, place, strand) of the best place in each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base, n = GENOME[np.frombuffer(b"".join(texts), np.uint8)], len(probe)
    ends = np.cumsum(size)
    count = len(base) - n + 1
    plus_first = max_mm == 0 and not set(probe) - set("ACGT")
    best = np.full(len(texts), np.iinfo(np.int64).max)
    if count > 0:
        row = np.repeat(np.arange(len(texts)), size)[:count]
        at = np.arange(count)
        place = at - (ends - size)[row]
        fits = ends[row] - at >= n
        for strand, pattern in enumerate((probe, reverse_complement(probe))):
            mm = np.zeros(count, np.int64)
            for j, c in enumerate(pattern):
                mm += (base[j : j + count] & MASK[c]) == 0
            ok = np.flatnonzero(fits & (mm <= max_mm))
            rank = (mm[ok] << 48) | (strand << 47 | place[ok] if plus_first else place[ok] << 1 | strand)
            np.minimum.at(best, row[ok], rank)
    out = []
    for x in best.tolist():
        low = x & ((1 << 48) - 1)
        place, strand = (low & ((1 << 47) - 1), low >> 47) if plus_first else (low >> 1, low & 1)
        out.append(None if x == np.iinfo(np.int64).max else (x >> 48, place, strand))
    return out


def probe_hit(seq: Column, probe: str, max_mm: int = 0) -> Column:
    """struct(mm, pos, strand, site) of the best place of the probe in seq, or null; scanned in Arrow batches.

    An exact probe of plain bases prefers the plus strand, wherever it is;
    otherwise fewest mismatches, then leftmost, then plus.
    """
    probe = normalized(probe)

    @F.arrow_udf(PROBE_SCHEMA)
    def best(seqs: pa.Array) -> pa.Array:
        texts = [b"" if x is None else x.encode() for x in seqs.to_pylist()]
        found = [x for a, b in _parts(np.array(list(map(len, texts)), np.int64)) for x in _best_places(texts[a:b], probe, max_mm)]
        rows = [None if x is None else {"mm": x[0], "pos": x[1], "strand": "+-"[x[2]], "site": t[x[1] : x[1] + len(probe)].decode()} for t, x in zip(texts, found, strict=True)]
        return pa.array(rows, pa.struct([("mm", pa.int32()), ("pos", pa.int32()), ("strand", pa.string()), ("site", pa.string())]))

    return best.asNondeterministic()(seq)  # else a filter would compute it once more


def with_probe(rows: DataFrame, name: str, probe: str, max_mm: int = 0, require: bool = False) -> DataFrame:
    """rows (with seq) and the probe's columns; with require only those where it is found."""
    got = rows.withColumn("probe", probe_hit(F.col("seq"), probe, max_mm))
    got = got.select(*rows.columns, F.lit(name).alias("probe_name"), F.lit(normalized(probe)).alias("probe_seq"), F.col("probe").isNotNull().alias("probe_found"), F.col("probe.strand").alias("probe_strand"), F.col("probe.pos").alias("probe_pos"), F.col("probe.mm").alias("probe_mm"), F.col("probe.site").alias("probe_site"))
    return got.where("probe_found") if require else got


NESTED = [pa.field(x, pa.string() if x in ("experiment_id", "type") else pa.int32() if x.endswith("_mm") else pa.int64()) for x in ("experiment_id", "start", "end", "length", "type", "fwd_mm", "rev_mm")]


def _first_of_each(found: pa.Table) -> pa.Table:
    """Of each record's amplicons that with fewest mismatches, the longest, the leftmost."""
    order = [found["record"], pc.add(found["fwd_mm"], found["rev_mm"]), pc.negate(found["length"]), *(found[x] for x in ("start", "end")), *(pc.rank(found[x], tiebreaker="dense") for x in ("experiment_id", "type"))]
    at = np.lexsort([x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy() for x in reversed(order)])
    record = order[0].to_numpy()[at]
    return found.take(pa.array(at[np.flatnonzero(np.diff(record, prepend=-1))]))


def inner_amplicons(seqs: pa.Array, inner: list[Pair], max_mm: int = 0, window: int = 0, min_length: int = 0, max_length: int = 0) -> pa.Array:
    """NESTED of the best inner amplicon of each sequence, or null; each distinct one of the batch is scanned once."""
    rows, of = distinct_rows([seqs])
    texts = [(x or "").encode() for (x,) in rows]
    size = pa.array(list(map(len, texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), size, pa.array([0] * len(texts), pa.int64()), size, pa.array(texts, pa.binary())], ["record", "len", "at", "owned", "seq"])
    names, best = ["record", *(x.name for x in NESTED)], None
    for part in parts(batch):
        longest = max_length or max(map(len, texts), default=0) or 1
        for found in block_amplicons(part, inner, max_mm, window, min_length, longest, "forward revcomp"):
            some = _first_of_each(pa.table(found).select(names))
            best = some if best is None else _first_of_each(pa.concat_tables([best, some]))
    if best is None:
        return pa.nulls(len(of), pa.struct(NESTED))
    best = best.combine_chunks()
    at = np.full(len(texts), -1)
    at[best["record"].to_numpy()] = np.arange(len(best))
    take = pa.array(at, mask=at < 0).take(of)
    columns = [best[x.name].cast(x.type).combine_chunks() for x in NESTED]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.StructArray.from_arrays([c.take(take) for c in columns], fields=NESTED, mask=take.is_null())


def with_nested(rows: DataFrame, inner: list[Pair], max_mm: int = 0, window: int = 0, min_length: int = 0, max_length: int = 0, require: bool = False) -> DataFrame:
    """rows (with seq) and their best inner amplicon: fewest mismatches, longest, leftmost; of any length unless bounded, as its record is an amplicon."""

    @F.arrow_udf("experiment_id string, start long, end long, length long, type string, fwd_mm int, rev_mm int")
    def best(seqs: pa.Array) -> pa.Array:
        return inner_amplicons(seqs, inner, max_mm, window, min_length, max_length)

    got = rows.withColumn("inner", best.asNondeterministic()(F.col("seq")))  # else a filter would compute it once more
    got = got.select(*rows.columns, *[F.col("inner")[x.name].alias(f"inner_{x.name}") for x in NESTED], F.col("inner").isNotNull().alias("inner_found"))
    return got.where("inner_found") if require else got
