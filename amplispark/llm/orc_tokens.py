"""Token ids as ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Rows are dealt by ranges of the id and sorted, so files and their stripes hold
narrow ranges: a reader's predicate on the id prunes files and stripes by their
statistics and Bloom filters, and Spark splits files at stripes. Each row also
has the number of ids before it in its file; with the files' sums, which are
one number a file, that gives the place of every document in the whole.

Nulls and edge cases: a null text is like an empty one and has the end id only.
Null ids come first. Rows of equal ids are ordered by a hash of their text;
equal rows stay. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .common import fresh_path, held

END_ID = 2
BROADCAST_FILES = 200_000
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000
#: Words that a worker remembers with their ids.
REMEMBERED = 300_000
#: Bytes of text encoded together: the larger, the fewer distinct words are looked up.
ENCODE_BYTES = 2 << 20
#: Fixed value: the split pattern of the tokenizer's file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words whose normal form is their lower case, letter by letter.
PLAIN = regex.compile(r"[!-~\xa1-\xac\xae-\xff]+")


#: Kinds of bytes: white space, letters, digits, other printable ASCII, and those whose word is cut by the pattern itself.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = OTHER
KIND[ord("'")] = ODD
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[text.SPACE] = SPACE


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What the pattern makes of plain words, other words whole, and each text's n + 1 bounds among them.

    Plain words are of printable ASCII without apostrophes and the letters from
    U+00C0 to U+00FF, which are pairs of bytes that begin with C3; these become
    lower case here.
    """
    n = len(data)
    if not n:
        return text.strings(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    letter = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    lead, after = lead[letter], after[letter]
    kind[lead] = kind[lead + 1] = LETTER
    data = data.copy()
    data[lead + 1] = after + np.where(after <= 0x9E, 32, 0).astype(np.uint8)
    inside = kind != SPACE
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    cut = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    word = np.cumsum(opens, dtype=_index(n)) - 1
    odd = np.zeros(int(word[-1]) + 2, bool)
    odd[word[kind == ODD]] = True
    starts = opens
    starts[1:] |= cut & inside[1:] & ~odd[word[1:]]
    starts = np.flatnonzero(starts)
    del word
    before = np.cumsum(inside, dtype=_index(n))
    bounds = np.append(before[starts] - 1, before[-1]).astype(np.int64)
    return text.strings(data[inside], bounds), np.searchsorted(starts, offsets)


def _index(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


class WordEncoder:
    """Ids by the tokenizers library's BPE model, which sees each distinct piece once.

    No piece, and no step of the normalizer, reaches across ASCII white space,
    so the words' ids on end are the text's ids. Plain words are cut into pieces
    all at once; others go through the library's normalizer one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .bpe import byte_letters

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_letters()))
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Ids of a lower-case piece that the pattern doesn't split."""
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            got = self.pieces[piece] = array("i", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return got

    def word(self, word: str) -> bytes:
        if "<|" in word or not ((word.isascii() and word.isprintable()) or PLAIN.fullmatch(word)):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, np.int32).tobytes()
        word = word.lower()
        if word.isalpha():
            return self.piece(word)
        return b"".join(map(self.piece, SPLIT.findall(word)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each text's followed by the end id, and the n + 1 bounds."""
        data, offsets = text.flat(texts)
        if b"<|" in data.tobytes():  # a special token may be meant
            found, bounds = text.words(data, offsets)
        else:
            found, bounds = pieces(text.LOWER[data], offsets)
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = map(self.pieces.get, distinct)
        each = [self.word(w) if got is None else got for w, got in zip(distinct, known, strict=True)]
        ids, at = text.gathered(pa.array(each, pa.large_binary()), coded.indices, np.int32)
        at = at[bounds]
        ends = at[1:] + np.arange(len(texts))
        out = np.full(len(ids) + len(texts), END_ID, np.int32)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = ids
        return out, np.concatenate([[0], ends + 1])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = held("orc_tokens")
        own = kept.get(path) or kept.setdefault(path, WordEncoder(path))
        before = 0
        for batch in batches:
            at = 0
            for part in text.chunks(batch.column(1), ENCODE_BYTES):
                ids, bounds = own.encode(part)
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(before + bounds[:-1]), lists], ["doc_id", "before", "ids"])
                at += len(part)
                before += int(bounds[-1])
            text.release()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode every text and write (doc_id, before, ids) as ORC in ascending order of the id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = F.col("doc_id"), F.xxhash64("text"), F.col("text")  # many rows of one id, or of none, go to several files
    rows = (rows.repartitionByRange(parts, *order[:2]) if parts else rows.repartitionByRange(*order[:2])).sortWithinPartitions(*order)
    ids = rows.mapInArrow(_encode(tokenizer_path), "doc_id long, before long, ids array<int>")
    options = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    ids.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, before, ids, file); a filter on doc_id is pushed down to files and stripes."""
    return spark.read.schema("doc_id long, before long, ids array<int>").orc(path).withColumn("file", F.col("_metadata.file_name"))


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list as little-endian 32-bit integers."""
    raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    at = (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())


def file_starts(tokens: DataFrame) -> DataFrame:
    """(file, base): the number of ids in the files before, which go by their number. One row a file is gathered."""
    number = lambda name: int(re.match(r"part-(\d+)", name)[1])
    sums = sorted((tuple(x) for x in tokens.groupBy("file").agg(F.sum(F.size("ids")).alias("n")).collect()), key=lambda x: (number(x[0]), x[0]))
    base, rows = 0, []
    for name, n in sums:
        rows.append((name, base))
        base += n
    return tokens.sparkSession.createDataFrame(rows, "file string, base long")


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files, read them back, and return doc_id, start, n_tokens and ids_crc32 of every row."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path, id_col, text_col)
    tokens = read_tokens(docs.sparkSession, path)
    starts = file_starts(tokens)
    if starts.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    got = tokens.join(starts, "file")
    return got.select("doc_id", (F.col("base") + F.col("before")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
