"""Primer sites with mismatches: every place of every orientation, in vectorised scans.

Sequences of a batch are laid end to end as base masks, and each pattern is
compared letter by letter at all places at once. Long records are cut into
blocks beforehand, each with as many bases of the next as the longest primer
needs less one; a block owns the sites that begin in it, so each is found once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import BASES, MASK, slices
from .panel import Pair, orientations

BLOCK_BASES, SCAN_BASES = 1 << 20, 2 << 20
#: Bases of a block in the seed join, k-mers of a seed at most, and of all seeds that are broadcast.
SEED_BASES, MOST_KMERS, BROADCAST_KMERS = 4096, 50_000, 500_000
#: Letters of a seed at most whose code over A, C, G, T and N is a number of 64 bits.
CODED_SEED = 27
SCHEMA = "record string, len long, pair_ord int, orient string, pos long, mm int, mm_idx array<int>"

GENOME = np.zeros(256, np.uint8)
for _c in "ACGT":
    GENOME[ord(_c)] = MASK[_c]


def blocks(records: DataFrame, overlap: int, size: int = BLOCK_BASES) -> DataFrame:
    """(record, seq) cut into (record, len, at, owned, seq), seq in bytes."""
    rows = records.select("record", "seq", F.octet_length("seq").cast("long").alias("len")).where("len > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(size).cast("long"))
    rows = rows.select("record", "len", F.inline(slices(F.col("seq"), starts, size + overlap)))
    return rows.select("record", "len", "at", F.least(F.lit(size).cast("long"), F.col("len") - F.col("at")).alias("owned"), "seq")


def _patterns(pairs: list[Pair], max_mm: int, window: int, orients: str = "ABab") -> list[tuple[int, str, np.ndarray, int, int]]:
    """(pair, orientation, masks, first and end of the protected bases)."""
    out = []
    for i, p in enumerate(pairs):
        for name, seq in orientations(p).items():
            if name not in orients:
                continue
            n = len(seq)
            w = min(window, n)
            low, high = (n - w, n) if name in "AB" else (0, w)
            out.append((i, name, np.array([MASK[c] for c in seq], np.uint8), low, high))
    return out


def _scan(patterns, max_mm: int, cap: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield from _rows(part, patterns, max_mm, cap)

    return run


#: Share of all places below which they are looked at one by one.
FEW = 1 / 16


def near(base: np.ndarray, pattern: np.ndarray, ok: np.ndarray, protected: range, max_mm: int) -> np.ndarray:
    """Places among ok where the protected letters match and at most max_mm of the others don't.

    Letters are compared at all places at once while many are left, and then at those that are left.
    """
    count, places = len(ok), None
    for j in protected:
        if places is None:
            ok &= (base[j : j + count] & pattern[j]) != 0
            if (j - protected.start) % 3 == 2:
                found = np.flatnonzero(ok)
                places = found if len(found) < count * FEW else None
        else:
            places = places[(base[places + j] & pattern[j]) != 0]
    others = [j for j in range(len(pattern)) if j not in protected]
    kind = np.uint8 if len(others) < 256 else np.uint32
    if places is None and len(others) > 0:
        mm = np.zeros(count, kind)
        for j in others:
            mm += (base[j : j + count] & pattern[j]) == 0
        return np.flatnonzero(ok & (mm <= max_mm))
    if places is None:
        return np.flatnonzero(ok)
    mm = np.zeros(len(places), kind)
    for j in others:
        mm += (base[places + j] & pattern[j]) == 0
    return places[mm <= max_mm]


def laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of a batch on end: base masks, each base's block, which bases are owned, how many follow in the block, and the blocks' ends."""
    texts = batch.column(4).to_pylist()
    size = np.array([len(x) for x in texts])
    ends = np.cumsum(size)
    base = GENOME[np.frombuffer(b"".join(texts), np.uint8)]
    row = np.repeat(np.arange(len(size)), size)
    owned = (np.arange(len(base)) - np.repeat(ends - size, size)) < np.repeat(batch.column(3).to_numpy(), size)
    return base, row, owned, np.repeat(ends, size) - np.arange(len(base)), ends


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of blocks of about SCAN_BASES."""
    ends = np.cumsum(pc.binary_length(batch.column(4)).to_numpy())
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SCAN_BASES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mismatches(base: np.ndarray, pattern: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place which letters of the pattern don't match."""
    bad = np.zeros((len(places), len(pattern)), bool)
    for j in range(len(pattern)):
        bad[:, j] = (base[places + j] & pattern[j]) == 0
    return bad


def _rows(batch: pa.RecordBatch, patterns, max_mm: int, cap: int = 0) -> Iterator[pa.RecordBatch]:
    base, row, owned, room, ends = laid_out(batch)
    begins = np.append(0, ends[:-1])
    at = batch.column(2).to_numpy()
    for pair_ord, orient, pattern, low, high in patterns:
        n = len(pattern)
        count = len(base) - n + 1
        if count <= 0:
            continue
        places = near(base, pattern, owned[:count] & (room[:count] >= n), range(low, high) if max_mm else range(n), max_mm)
        bad = mismatches(base, pattern, places)
        mm, of = bad.sum(1), row[places]
        if cap:  # a record's leftmost sites are among its blocks' leftmost ones
            first = np.searchsorted(of, of)
            keep = np.arange(len(of)) - first < cap
            places, bad, mm, of = places[keep], bad[keep], mm[keep], of[keep]
        if not len(places):
            continue
        yield from _site_rows(batch, pair_ord, orient, places, bad, row, begins, at)


def _site_rows(batch: pa.RecordBatch, pair_ord: int, orient: str, places: np.ndarray, bad: np.ndarray, row: np.ndarray, begins: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sites of one orientation as rows."""
    if not len(places):
        return
    mm, of = bad.sum(1), row[places]
    idx = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(mm)]), pa.int32()), pa.array(np.nonzero(bad)[1], pa.int32()))
    pos = places - begins[of] + at[of]
    take = pa.array(of)
    yield pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(of), pair_ord), pa.int32()), pa.array([orient] * len(of), pa.string()), pa.array(pos, pa.int64()), pa.array(mm, pa.int32()), idx],
        ["record", "len", "pair_ord", "orient", "pos", "mm", "mm_idx"],
    )


def hits(records: DataFrame, pairs: list[Pair], max_mm: int = 0, window: int = 0, cap: int = 0, orients: str = "ABab") -> DataFrame:
    """Sites of the given orientations of all pairs in records (record, seq).

    N in a primer matches any base, N in a record none. Up to max_mm mismatches,
    none of them in the `window` bases at the primer's 3' end. cap, if not 0,
    keeps so many sites of a record, pair and orientation, leftmost first.
    """
    if max_mm < 0 or window < 0 or cap < 0:
        raise ValueError("mismatches, window and cap can't be negative")
    overlap = max((max(len(p.forward), len(p.reverse)) for p in pairs), default=1) - 1
    found = blocks(records, overlap).select("record", "len", "at", "owned", "seq").mapInArrow(_scan(_patterns(pairs, max_mm, window, orients), max_mm, cap), SCHEMA)
    if cap:
        rank = F.row_number().over(Window.partitionBy("record", "pair_ord", "orient").orderBy("pos"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")
    return found


def seed_size(seq: str, protected: range, off: int, k: int, max_mm: int) -> int:
    """Number of k-mers over A, C, G, T and N within max_mm mismatches of the letters at off, none of them in protected places."""
    by_mm = [1] + [0] * max_mm
    for j in range(off, off + k):
        fits = len(BASES[seq[j]])
        other = 0 if j in protected else 5 - fits
        by_mm = [by_mm[m] * fits + (by_mm[m - 1] * other if m else 0) for m in range(max_mm + 1)]
    return sum(by_mm)


def seed_place(seq: str, protected: range, max_mm: int, seed: int) -> tuple[int, int, int]:
    """(number of k-mers, place, length) of the seed with fewest k-mers; of equal ones that with most protected places, then the first."""
    k = min(seed, len(seq))
    each = [(seed_size(seq, protected, off, k, max_mm), -len(set(range(off, off + k)) & set(protected)), off) for off in range(len(seq) - k + 1)]
    size, _, off = min(each)
    return size, off, k


def seed_kmers(seq: str, protected: range, off: int, k: int, max_mm: int) -> list[str]:
    """The k-mers that seed_size() counts."""
    found = [("", 0)]
    for j in range(off, off + k):
        fits, free = BASES[seq[j]], j not in protected
        found = [(kmer + b, mm + (b not in fits)) for kmer, mm in found for b in "ACGTN" if b in fits or (free and mm < max_mm)]
    return [kmer for kmer, _ in found]


class _Seeds:
    """Seeds of one length by the codes of their k-mers: the side of the join that all tasks have."""

    def __init__(self, k: int, seeds: list[tuple]):
        letters = np.frombuffer("".join(x[0] for x in seeds).encode(), np.uint8).reshape(-1, k)
        code = self.codes(FIVE[letters].ravel(), k)[::k]
        self.k = k
        self.kmers, first = np.unique(code, return_index=True)
        at = np.searchsorted(self.kmers, code)
        self.order = np.argsort(at, kind="stable")
        self.begin = np.append(0, np.cumsum(np.bincount(at, minlength=len(self.kmers))))
        self.places = sorted({(i, name, off, tuple(accepts), low, high) for _, i, name, off, accepts, low, high in seeds}, key=lambda x: x[:3])
        number = {x: n for n, x in enumerate(self.places)}
        self.of = np.array([number[(i, name, off, tuple(accepts), low, high)] for _, i, name, off, accepts, low, high in seeds])[self.order]
        # a table of all k-mers where it is small, else a search among the seeds'
        self.table = None
        if 5**k <= TABLE_KMERS:
            self.table = np.full(5**k, -1, np.int32)
            self.table[self.kmers] = np.arange(len(self.kmers))

    @staticmethod
    def codes(letters: np.ndarray, k: int) -> np.ndarray:
        """Code of the k letters from each place on; those at the end go on into nothing."""
        padded = np.append(letters, np.zeros(k - 1, letters.dtype))
        out = np.zeros(len(letters), np.int64 if 5**k > 1 << 31 else np.int32)
        for j in range(k):
            out *= 5
            out += padded[j : j + len(letters)]
        return out

    def found(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number in self.places) of all k-mers that are a seed's."""
        code = self.codes(letters, self.k)[: max(len(letters) - self.k + 1, 0)]
        if self.table is not None:
            kmer = self.table[code]
            at = np.flatnonzero(kmer >= 0)
            kmer = kmer[at]
        else:
            kmer = np.minimum(np.searchsorted(self.kmers, code), len(self.kmers) - 1)
            at = np.flatnonzero(self.kmers[kmer] == code)
            kmer = kmer[at]
        count = self.begin[kmer + 1] - self.begin[kmer]
        which = np.repeat(np.arange(len(at)), count)
        return at[which], self.of[np.repeat(self.begin[kmer] - (np.cumsum(count) - count), count) + np.arange(len(which))]


#: K-mers of all letters up to which a table of them is kept in each task.
TABLE_KMERS = 1 << 20
FIVE = np.full(256, 4, np.uint8)
for _k, _c in enumerate("ACGT"):
    FIVE[ord(_c)] = _k


def _joined_seeds(tables: dict[int, list[tuple]], max_mm: int):
    """Places of all blocks joined with the seeds' k-mers, and verified letter by letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [_Seeds(k, seeds) for k, seeds in sorted(tables.items())]
        for batch in batches:
            for part in parts(batch):
                base, row, owned, room, ends = laid_out(part)
                letters = FIVE[np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8)]
                begins, at = np.append(0, ends[:-1]), part.column(2).to_numpy()
                for seeds in each:
                    place, number = seeds.found(letters)
                    order = np.argsort(number, kind="stable")
                    bounds = np.searchsorted(number[order], np.arange(len(seeds.places) + 1))
                    for n in np.flatnonzero(np.diff(bounds)).tolist():
                        i, name, off, accepts, low, high = seeds.places[n]
                        start = place[order[bounds[n] : bounds[n + 1]]] - off
                        start = start[(start >= 0) & (start + len(accepts) <= len(base))]
                        start = start[owned[start] & (room[start] >= len(accepts))]
                        bad = mismatches(base, np.array([sum(MASK[x] for x in a) for a in accepts], np.uint8), start)
                        keep = (bad.sum(1) <= max_mm) & ~bad[:, low:high].any(1)
                        yield from _site_rows(part, i, name, start[keep], bad[keep], row, begins, at)

    return run


def seed_hits(records: DataFrame, pairs: list[Pair], max_mm: int = 0, window: int = 0, seed: int = 12, orients: str = "ABab") -> DataFrame:
    """The sites that hits() finds, by one join of all places with the seeds of the whole panel.

    Each orientation has one seed of at most `seed` letters, where it stands for
    fewest k-mers, with all k-mers within max_mm mismatches of it. Its places are
    verified letter by letter. Seeds that can be broadcast go to all tasks and are
    looked up by their codes; a larger panel's, or longer ones, are joined in
    DataFrame operations. An orientation whose seed stands for more than
    MOST_KMERS k-mers is scanned as in hits().
    """
    if max_mm < 0 or window < 0 or seed < 1:
        raise ValueError("mismatches and window can't be negative, and a seed has a letter")
    spark, kmers, scanned = records.sparkSession, {}, []
    overlap = max((max(len(p.forward), len(p.reverse)) for p in pairs), default=1) - 1
    for i, p in enumerate(pairs):
        for name, seq in orientations(p).items():
            if name not in orients:
                continue
            n = len(seq)
            w = min(window, n)
            protected = range(n - w, n) if name in "AB" else range(w)
            size, off, k = seed_place(seq, protected, max_mm, seed)
            if size > MOST_KMERS:
                scanned.append((i, name))
            else:
                accepts = [BASES[c] for c in seq]
                kmers.setdefault(k, []).extend((x, i, name, off, accepts, protected.start, protected.stop) for x in seed_kmers(seq, protected, off, k, max_mm))
    got = [found.where((F.col("pair_ord") == i) & (F.col("orient") == name)) for i, name in scanned for found in [hits(records, pairs, max_mm, window, 0, name)]]
    if kmers and max(kmers) <= CODED_SEED and sum(map(len, kmers.values())) <= BROADCAST_KMERS:
        rows = blocks(records, overlap).select("record", "len", "at", "owned", "seq")
        got.append(rows.mapInArrow(_joined_seeds(kmers, max_mm), SCHEMA))
        kmers = {}
    rows = blocks(records, overlap, SEED_BASES).withColumn("size", F.octet_length("seq"))
    for k, seeds in sorted(kmers.items()):
        table = spark.createDataFrame(seeds, "kmer string, pair_ord int, orient string, off int, accepts array<string>, low int, high int")
        if len(seeds) <= BROADCAST_KMERS:
            table = F.broadcast(table)
        places = F.when(F.col("size") >= k, F.sequence(F.lit(0), F.col("size") - k)).otherwise(F.array().cast("array<int>"))
        words = rows.select("record", "len", "at", "owned", "seq", "size", F.inline(slices(F.col("seq"), places, k)).alias("place", "kmer"))
        near = words.withColumn("kmer", F.regexp_replace(F.col("kmer").cast("string"), "[^ACGT]", "N")).join(table, "kmer")
        start, n = F.col("place") - F.col("off"), F.size("accepts")
        near = near.where((start >= 0) & (start < F.col("owned")) & (start + n <= F.col("size")))
        near = near.withColumn("site", F.substring(F.col("seq"), start + 1, n).cast("string"))
        bad = F.filter(F.sequence(F.lit(0), n - 1), lambda j: ~F.contains(F.get("accepts", j), F.substring(F.col("site"), j + 1, F.lit(1))))
        near = near.select("record", "len", "pair_ord", "orient", (F.col("at") + start).alias("pos"), "low", "high", bad.alias("mm_idx"))
        near = near.where((F.size("mm_idx") <= max_mm) & ~F.exists("mm_idx", lambda j: (j >= F.col("low")) & (j < F.col("high"))))
        got.append(near.select("record", "len", "pair_ord", "orient", "pos", F.size("mm_idx").alias("mm"), "mm_idx"))
    return reduce(DataFrame.unionByName, got)
