"""Amplicons: sites joined within a record and pair, linear and circular."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import MASK, slices
from ..session import cut, small
from .hits import blocks, hits, laid_out, mismatches, near, parts
from .panel import Pair, orientations, panel_table

#: Longest amplicon unless asked otherwise; 0 asks for any length, which joins all sites of a record and pair.
MOST_LENGTH = 2000
#: Longest amplicon that a block's scan gives by itself, amplicons that it gives at once, and their bases if it cuts them.
SCAN_LENGTH, PAIRS_AT_ONCE, CUT_BASES = 1 << 16, 500_000, 4 << 20
UTF8 = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
SCANNED = "record string, pair_ord int, experiment_id string, start long, end long, length long, type string, fwd_mm int, rev_mm int, fwd_mm_i string, rev_mm_i string, is_wrap boolean"
#: Bases of a block from which amplicons are cut, and of the next block that it holds as well.
SEQUENCE_BLOCK, SEQUENCE_MORE = 1 << 16, 1 << 12
KEY = ("record", "pair_ord", "start", "end", "type", "is_wrap")
COLUMNS = ("record", "pair_ord", "experiment_id", "start", "end", "length", "type", "fwd_mm", "rev_mm", "fwd_mm_i", "rev_mm_i", "is_wrap")


def products(found: DataFrame, pairs: list[Pair], min_length: int = 0, max_length: int = MOST_LENGTH, circular: bool = False) -> DataFrame:
    """Amplicons of sites that are there already: see amplicons()."""
    orient = F.col("orient")
    return _joined(found.where(orient.isin("A", "B")), found.where(orient.isin("a", "b")), pairs, min_length, max_length, circular)


def amplicons(records: DataFrame, pairs: list[Pair], max_mm: int = 0, window: int = 0, min_length: int = 0, max_length: int = MOST_LENGTH, circular: bool = False, cap: int = 0, kinds: str = "forward revcomp", sequences: bool = False) -> DataFrame:
    """Pairs of opposing sites in records (record, seq) as amplicons of the given kinds, with their bases as seq if asked for.

    The reverse site begins right of the forward site; on a circular record
    also left of it, across the origin. Amplicons of at most SCAN_LENGTH bases on
    linear records come straight from the scan, as a block holds as many bases of
    the next: nothing is shuffled, their bases included. Others, and those of capped sites, are joined
    by record, pair, type and, where the length is bounded, by stretches of the
    record as long as the bound, of which an amplicon touches two at most.
    """
    if max_mm < 0 or window < 0 or cap < 0:
        raise ValueError("mismatches, window and cap can't be negative")
    longest = [p.max_length or max_length for p in pairs]
    if pairs and not circular and not cap and 0 not in longest and max(longest) <= SCAN_LENGTH:
        n = max(max(len(p.forward), len(p.reverse)) for p in pairs)
        rows = blocks(records, max(n, *longest) - 1).select("record", "len", "at", "owned", "seq")
        return rows.mapInArrow(_scanned(pairs, max_mm, window, min_length, max_length, kinds, sequences), SCANNED + ", seq string" * sequences)
    roles = [o for kind, o in (("forward", "Ab"), ("revcomp", "Ba")) if kind in kinds]
    left, right = (hits(records, pairs, max_mm, window, cap, "".join(o[i] for o in roles)) for i in (0, 1))
    found = _joined(left, right, pairs, min_length, max_length, circular)
    return with_sequences(found, records) if sequences else found


class _Sites:
    """Places of one orientation, its mismatches, and their text by row of the last."""

    def __init__(self, base: np.ndarray, seq: str, ok: np.ndarray, left: bool, max_mm: int, window: int):
        n = len(seq)
        pattern, w = np.array([MASK[c] for c in seq], np.uint8), min(window, n)
        protected = range(n) if not max_mm else range(n - w, n) if left else range(w)
        self.n, count = n, len(base) - n + 1
        self.places = near(base, pattern, ok[:count].copy(), protected, max_mm) if count > 0 else np.zeros(0, np.int64)
        bad = mismatches(base, pattern, self.places)
        self.mm = bad.sum(1).astype(np.int32)
        kinds, self.kind = np.unique(bad, axis=0, return_inverse=True) if max_mm and len(bad) else (np.zeros((1, n), bool), np.zeros(len(bad), np.int64))
        at = [np.flatnonzero(k) for k in kinds]
        self.texts = pa.array([",".join(map(str, x if left else n - 1 - x)) for x in at], pa.string())
        self.kind = self.kind.ravel()


def _scanned(pairs: list[Pair], max_mm: int, window: int, min_length: int, max_length: int, kinds: str, sequences: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield from block_amplicons(part, pairs, max_mm, window, min_length, max_length, kinds, sequences)

    return run


def block_amplicons(batch: pa.RecordBatch, pairs: list[Pair], max_mm: int, window: int, min_length: int, max_length: int, kinds: str, sequences: bool = False) -> Iterator[pa.RecordBatch]:
    """Amplicons whose left site a block owns."""
    base, row, owned, room, ends = laid_out(batch)
    text_of = b"".join(batch.column(4).to_pylist()) if sequences else b""
    offset = batch.column(2).to_numpy() - np.append(0, ends[:-1])
    for i, p in enumerate(pairs):
        low, high = p.min_length or min_length, p.max_length or max_length
        o = orientations(p)
        for kind, a, b in (("forward", "A", "b"), ("revcomp", "B", "a")):
            if kind not in kinds:
                continue
            left = _Sites(base, o[a], owned & (room >= len(o[a])), True, max_mm, window)
            if not len(left.places):
                continue
            right = _Sites(base, o[b], room >= len(o[b]), False, max_mm, window)
            first = np.searchsorted(right.places, np.maximum(left.places, left.places + low - right.n - 1) if low else left.places, "right")
            last = np.searchsorted(right.places, np.minimum(left.places + high, ends[row[left.places]]) - right.n, "right")
            count = np.maximum(last - first, 0)
            sums = np.cumsum(count)
            start = 0
            while start < len(count):  # so many amplicons at a time that they fit in memory
                stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
                each = count[start:stop]
                total = int(each.sum())
                if total:
                    le = np.repeat(np.arange(start, stop), each)
                    ri = np.repeat(first[start:stop] - (np.cumsum(each) - each), each) + np.arange(total)
                    of = row[left.places[le]]
                    begin, at = left.places[le] + offset[of], right.places[ri] + offset[of]
                    end = at + right.n
                    text = lambda s, k: s.texts.take(pa.array(s.kind[k]))
                    same = lambda x, t: pa.array(np.full(total, x), t)
                    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(total, np.int32)), pa.array([p.id], pa.string())).cast(pa.string())
                    types = pa.DictionaryArray.from_arrays(pa.array(np.zeros(total, np.int32)), pa.array([kind], pa.string())).cast(pa.string())
                    columns = [batch.column(0).take(pa.array(of)), same(i, pa.int32()), names, pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(end - begin, pa.int64()), types, pa.array(left.mm[le]), pa.array(right.mm[ri]), text(left, le), text(right, ri), same(False, pa.bool_())]
                    if not sequences:
                        yield pa.RecordBatch.from_arrays(columns, list(COLUMNS))
                    else:
                        first_of, behind = left.places[le], right.places[ri] + right.n
                        some = max(1, CUT_BASES // high)
                        for k in range(0, total, some):
                            seqs = [text_of[x:y] for x, y in zip(first_of[k : k + some].tolist(), behind[k : k + some].tolist(), strict=True)]
                            yield pa.RecordBatch.from_arrays([*(c.slice(k, some) for c in columns), pc.cast(pa.array(seqs, pa.binary()), options=UTF8)], [*COLUMNS, "seq"])
                start = stop


def _joined(left: DataFrame, right: DataFrame, pairs: list[Pair], min_length: int, max_length: int, circular: bool) -> DataFrame:
    bounds = panel_table(left.sparkSession, pairs)
    low = F.when(F.col("min_length") > 0, F.col("min_length")).otherwise(min_length)
    high = F.when(F.col("max_length") > 0, F.col("max_length")).otherwise(max_length)
    kind = lambda name: F.when(F.col("orient") == name, "forward").otherwise("revcomp").alias("type")
    n = F.when(F.col("orient") == "b", F.length("rev")).otherwise(F.length("fwd")).cast("long").alias("n")
    lefts = left.select("record", "pair_ord", kind("A"), F.col("pos").alias("start"), F.col("mm").alias("fwd_mm"), F.col("mm_idx").alias("fi"))
    rights = right.join(small(bounds, len(pairs)), "pair_ord").select("record", "pair_ord", kind("b"), "pair_id", "len", low.alias("low"), high.alias("high"), F.col("pos").alias("at"), n, F.col("mm").alias("rev_mm"), F.col("mm_idx").alias("ri"))
    on = ["record", "pair_ord", "type"]
    wrap = F.col("at") < F.col("start")
    turn = F.lit(True)
    if max_length > 0 and all(p.max_length <= max_length for p in pairs):
        width = F.lit(max_length).cast("long")
        at = F.col("at")
        if circular:  # a right site near the origin lies behind the record's end as well
            rights = rights.withColumn("turned", F.explode(F.when(at < width, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
            at, turn = at + F.when(F.col("turned"), F.col("len")).otherwise(0), F.col("turned") == wrap
        lefts = lefts.withColumn("bin", F.explode(F.array(F.floor(F.col("start") / width), F.floor(F.col("start") / width) + 1)))
        rights = rights.withColumn("bin", F.floor(at / width))
        on = [*on, "bin"]
    length = F.col("at") + F.col("n") - F.col("start") + F.when(wrap, F.col("len")).otherwise(0)
    side = F.col("at") != F.col("start") if circular else F.col("at") > F.col("start")
    fits = ((F.col("low") == 0) | (length >= F.col("low"))) & ((F.col("high") == 0) | (length <= F.col("high")))
    flip = F.transform("ri", lambda i: F.col("n").cast("int") - 1 - i)
    text = lambda idx: F.array_join(idx.cast("array<string>"), ",")
    rows = lefts.join(rights, on).where(side & turn & fits)
    return rows.select("record", "pair_ord", F.col("pair_id").alias("experiment_id"), "start", (F.col("at") + F.col("n")).alias("end"), length.alias("length"), "type", "fwd_mm", "rev_mm", text(F.col("fi")).alias("fwd_mm_i"), text(flip).alias("rev_mm_i"), wrap.alias("is_wrap"))


def sequence_of(seq: Column) -> Column:
    """The amplicon's bases, from its record's; across the origin where it wraps."""
    start = F.col("start").cast("int")
    plain = F.substring(seq, start + 1, F.col("length").cast("int"))
    return F.when(F.col("is_wrap"), F.concat(F.substring(seq, start + 1, F.length(seq)), F.substring(seq, F.lit(1), F.col("end").cast("int")))).otherwise(plain)


def with_sequences(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows with their bases, seq, cut from blocks of the records.

    A block holds the first SEQUENCE_MORE bases of the next, so an amplicon of no
    more is cut from the block it begins in; longer ones and those across the
    origin are put together from the blocks they touch. No record is shuffled
    whole, nor stands beside each of its amplicons.
    """
    size = SEQUENCE_BLOCK
    starts = F.sequence(F.lit(0).cast("long"), F.octet_length("seq").cast("long") - 1, F.lit(size).cast("long"))
    blocks = records.where("seq != ''").select(F.col("record").alias("of"), F.inline(slices(F.col("seq"), starts, size + SEQUENCE_MORE)))
    blocks = blocks.select("of", F.floor(F.col("at") / size).alias("block"), F.col("seq").alias("raw"))
    columns, short = rows.columns, ~F.col("is_wrap") & (F.col("length") <= SEQUENCE_MORE)
    block = F.floor(F.col("start") / size)
    whole = rows.where(short).join(blocks, (F.col("record") == F.col("of")) & (block == F.col("block")))
    whole = whole.select(*columns, F.substring("raw", (F.col("start") - F.col("block") * size + 1).cast("int"), F.col("length").cast("int")).cast("string").alias("seq"))
    end = F.col("start") + F.col("length")  # beyond the record's end where it wraps, which has length - end + start bases
    length = F.when(F.col("is_wrap"), end - F.col("end"))
    span = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    spans = F.when(F.col("is_wrap"), F.array(span(F.col("start"), length), span(F.lit(0), F.col("end")))).otherwise(F.array(span(F.col("start"), end)))
    parts = rows.where(~short).select(*columns, F.posexplode(spans).alias("n", "span")).where("span.hi > span.lo")
    parts = parts.select(*columns, "n", "span", F.explode(F.sequence(F.floor(F.col("span.lo") / size), F.floor((F.col("span.hi") - 1) / size))).alias("part"))
    low, high = F.greatest("span.lo", F.col("part") * size), F.least("span.hi", (F.col("part") + 1) * size)
    parts = parts.join(blocks, (F.col("record") == F.col("of")) & (F.col("part") == F.col("block")))
    piece = F.substring("raw", (low - F.col("part") * size + 1).cast("int"), (high - low).cast("int")).cast("string")
    rest = [c for c in columns if c not in KEY]
    grouped = parts.groupBy(*KEY).agg(F.first(F.struct(*rest)).alias("rest"), F.array_sort(F.collect_list(F.struct("n", "part", piece.alias("piece")))).alias("pieces"))
    long = grouped.select(*[F.col(c) if c in KEY else F.col(f"rest.{c}").alias(c) for c in columns], F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("seq"))
    return whole.unionByName(long)


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row for each amplicon, as overlapping chunks would give several; files are told apart where rows name them."""
    return rows.dropDuplicates([*(c for c in ("source_file",) if c in rows.columns), *KEY])


def coordinate_order(rows: DataFrame | None = None) -> list[Column]:
    """The total order of amplicons: by file, record, place, length and type, then all else; of rows only what they have."""
    names = ("source_file", "record", "start", "end", "length", "type", "experiment_id", "fwd_mm", "rev_mm", "fwd_mm_i", "rev_mm_i", "sequence_id", "seq")
    return [F.col(c) for c in names if rows is None or c in rows.columns]


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows in order, with their place in the whole from 1.

    A range sort deals rows out over all tasks; each then only needs the number
    of rows in the parts before its own, one number a part.
    """
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    placed = cut(rows.orderBy(*order).withColumn("placed_at", F.monotonically_increasing_id()))
    part = F.shiftright("placed_at", 33)
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    table = rows.sparkSession.createDataFrame(starts, "part_of long, before long")
    got = placed.join(small(table, len(starts)), part == F.col("part_of"))
    return got.select(*rows.columns, (F.col("before") + F.col("placed_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))


def sorted_globally(rows: DataFrame) -> DataFrame:
    """rows in the total order, as one output would have them."""
    return rows.orderBy(*coordinate_order(rows))


def ranked(rows: DataFrame, order: list[Column] | None = None, name: str = "rank") -> DataFrame:
    """Place of each amplicon within its record, in order of coordinates unless another is given.

    From places in the whole, less those before the record: no task sorts a whole record.
    """
    got = numbered(rows, [F.col("record"), *(order or coordinate_order(rows))], "place_of_all")
    first = got.groupBy(F.col("record").alias("first_of")).agg(F.min("place_of_all").alias("first"))
    got = got.join(first, F.col("record") == F.col("first_of"))
    return got.select(*rows.columns, (F.col("place_of_all") - F.col("first") + 1).alias(name))
