"""Byte-level BPE by a minimal acyclic transducer of frequent words, and exact merges for the rest.

Texts are cut into runs of non-space with at most one space before, as flat
arrays. Distinct runs of a block are looked up together: the transducer is a
shared-suffix automaton whose edges carry numbers that add up to the word's
rank, and the ranks index a table of ids. Runs it doesn't know are split by the
tokenizer's pattern, looked up again, and at last merged pair by pair.

The lexicon's words are counted over all texts; words of over WORD_BYTES bytes
never enter it, which bounds what the driver compiles. That only decides which
words take the quick way, as the merges give the same ids. The files lie in the
shared folder, where workers map them into memory.

Nulls and edge cases: a null text is like an empty one: no ids, and the hash of
nothing. The special token's text gives its id, as in the tokenizers library.
Repeated rows stay, other columns are ignored, an empty table gives an empty
result, and texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .common import fresh_path, held, open_fs, written

#: Words in the lexicon, and bytes of the longest.
LEXICON_WORDS, WORD_BYTES = 1 << 17, 64
#: Bytes of text whose words are counted together.
BLOCK_BYTES = 8 << 20
#: Bytes of text encoded together: the larger, the fewer distinct words are looked up.
ENCODE_BYTES = 1 << 20

#: Unicode white space, and the pattern of the tokenizer's pieces.
WHITE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
ODD_SPACE = regex.compile(r"[\x85\xa0  -     　]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        key = np.array([ids[a] * len(self.bytes) + ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.pair_rank = np.argsort(key)
        self.pairs = key[self.pair_rank]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece."""
        ids, _ = self.merge_all([word])
        return ids.tolist()

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces on end, and the n + 1 bounds.

        In each round every piece merges its lowest-ranked pair wherever that
        occurs, from left to right, until no piece has a pair to merge.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), size)
        done_ids, done_of = [], []
        rank = self._ranks(ids, of, np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.minimum.reduceat(rank, first)
            spans = np.diff(np.append(first, len(ids)))
            least = np.repeat(least, spans)
            over = least == NONE
            if over.any():
                done_ids.append(ids[over])
                done_of.append(of[over])
                ids, of, rank, least = ids[~over], of[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            joins = np.append(False, at[1:] == at[:-1] + 1)  # only where a letter pairs with itself
            if joins.any():
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(joins, 0, np.arange(len(at))))
                at = at[run % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            ids, of, rank = ids[keep], of[keep], rank[keep]
            changed = place[at]
            mark = np.zeros(len(ids), bool)
            mark[changed] = mark[np.maximum(changed - 1, 0)] = True
            changed = np.flatnonzero(mark)
            rank[changed] = self._ranks(ids, of, changed)
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return ids[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def _ranks(self, ids: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the given places."""
        out = np.full(len(at), NONE, np.int64)
        ok = np.flatnonzero((at + 1 < len(ids)) & (of[at] == of[np.minimum(at + 1, len(ids) - 1)]))
        key = ids[at[ok]].astype(np.int64) * len(self.bytes) + ids[at[ok] + 1]
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        out[ok] = np.where(self.pairs[i] == key, self.pair_rank[i], NONE)
        return out


NONE = 1 << 40


class Lexicon:
    """A minimal acyclic automaton over bytes; the numbers on a word's edges add up to its rank."""

    def __init__(self, edges: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        self.edges, self.targets, self.skips, self.final, self.starts, self.ids = edges, targets, skips, final, starts, ids

    @classmethod
    def build(cls, words: Iterable[bytes], encode) -> Lexicon:
        words = sorted(set(words))
        register: dict[tuple, int] = {}
        nodes: list[tuple] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(nodes)
                nodes.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # [accepts, edges]; one node for each byte of the last word
        last = b""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                node = freeze(path.pop())
                label = last[len(path) - 1]
                path[-1][1].append((label, node))

        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
        close(0)
        root = freeze(path[0])
        below = np.zeros(len(nodes), np.int64)
        rows = []
        for n, (accepts, out) in enumerate(nodes):  # targets are frozen first
            seen = int(accepts)
            for label, target in out:
                rows.append((n, label, target, seen))
                seen += int(below[target])
            below[n] = seen
        number = np.arange(len(nodes))
        number[[0, root]] = [root, 0] if len(nodes) > 1 else [0] * 2
        table = np.array(rows, np.int64).reshape(-1, 4)
        key = number[table[:, 0]] * 256 + table[:, 1]
        order = np.argsort(key)
        final = np.zeros(len(nodes), bool)
        final[number] = [x[0] for x in nodes]
        ids, starts = encode(words)
        return cls(key[order], number[table[:, 2]][order].astype(np.int32), table[:, 3][order].astype(np.int32), final, starts, ids)

    FIELDS = ("edges", "targets", "skips", "final", "starts", "ids")

    def save(self, uri: str) -> None:
        where, path = open_fs(uri)
        where.create_dir(path)
        for name in self.FIELDS:
            out = io.BytesIO()
            np.save(out, getattr(self, name))
            with where.open_output_stream(f"{path}/{name}.npy") as f:
                f.write(out.getvalue())

    @classmethod
    def load(cls, uri: str) -> Lexicon:
        """Mapped into memory where the folder is mounted, read from its store elsewhere."""
        where, path = open_fs(uri)
        if where.type_name == "local":
            return cls(*(np.load(f"{path}/{x}.npy", mmap_mode="r") for x in cls.FIELDS))
        return cls(*(np.load(io.BytesIO(where.open_input_stream(f"{path}/{x}.npy").read())) for x in cls.FIELDS))

    def rank(self, pieces: pa.Array) -> np.ndarray:
        """Rank of each piece, or -1; all pieces take a step at a time."""
        data, offsets = text.flat(pieces)
        n = len(pieces)
        out = np.full(n, -1, np.int64)
        if not len(self.edges):
            return out
        size = np.diff(offsets)
        live = np.flatnonzero(size > 0)
        state, number = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        edges, depth = np.asarray(self.edges), 0
        while len(live):
            key = state * 256 + data[offsets[live] + depth]
            at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
            ok = edges[at] == key
            live, at = live[ok], at[ok]
            state, number = self.targets[at].astype(np.int64), number[ok] + self.skips[at]
            depth += 1
            done = size[live] == depth
            hit = done & self.final[state]
            out[live[hit]] = number[hit]
            live, state, number = live[~done], state[~done], number[~done]
        return out


def runs(texts: pa.Array, special) -> tuple[pa.Array, np.ndarray]:
    """Runs that no piece of the tokenizer's crosses, and each text's n + 1 bounds among them."""
    data, offsets = text.flat(texts)
    raw = data.tobytes()
    if any(s.encode() in raw for s in special.special) or (not raw.isascii() and ODD_SPACE.search(raw.decode())):
        found, count = [], []
        for t in texts.to_pylist():
            before = len(found)
            for part in special.special_split.split(t or "") if special.special_split else [t or ""]:
                found += [part] if part in special.special else PIECES.findall(part)
            count.append(len(found) - before)
        return pa.array(found, pa.large_string()), np.concatenate([[0], np.cumsum(count, dtype=np.int64)]).astype(np.int64)
    n = len(data)
    if not n:
        return text.strings(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    space = text.SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    after_space &= ~first[:n]
    cut = first[:n].copy()
    cut |= space & ~after_space
    odd = after_space & ~space  # the word's first byte, unless a plain space joins it
    last = np.zeros(n, bool)
    last[:-1] = odd[1:]  # last space of a run before a word
    cut |= last
    joined = np.zeros(n, bool)
    joined[1:] = data[:-1] == 32
    cut |= odd & ~joined
    starts = np.flatnonzero(cut)
    return text.strings(data, np.append(starts, n)), np.searchsorted(starts, offsets)


class Encoder:
    """Ids of whole texts, exactly as the tokenizers library gives them."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.bytes_of = pa.array(vocabulary.bytes, pa.large_binary())
        self.digits_of = pa.array([b"%d," % i for i in range(len(vocabulary.bytes))], pa.large_binary())

    def _pieces(self, parts: list[str], ranks: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """More ids to follow the lexicon's, and each piece's start and length in both."""
        starts, lengths = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        seen = ranks >= 0
        starts[seen] = self.lexicon.starts[ranks[seen]]
        lengths[seen] = self.lexicon.starts[ranks[seen] + 1] - starts[seen]
        left = np.flatnonzero(~seen).tolist()
        special = self.vocabulary.special
        place = {p: i for i, p in enumerate(dict.fromkeys(parts[i] for i in left))}
        merged, at = self.vocabulary.merge_all([b"" if p in special else p.encode() for p in place])
        for p in special.keys() & place.keys():
            at = at.copy()
            merged = np.insert(merged, at[place[p]], special[p]).astype(np.int32)
            at[place[p] + 1 :] += 1
        which = np.fromiter((place[parts[i]] for i in left), np.int64, len(left))
        starts[left] = base + at[which]
        lengths[left] = np.diff(at)[which]
        return merged, starts, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the n + 1 bounds."""
        found, bounds = runs(texts, self.vocabulary)
        if not len(found):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = found.dictionary_encode()
        at = self.lexicon.rank(coded.dictionary)
        seen = at >= 0
        starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[seen], lengths[seen] = self.lexicon.starts[at[seen]], self.lexicon.starts[at[seen] + 1] - self.lexicon.starts[at[seen]]
        rest = np.flatnonzero(~seen)
        texts_left = coded.dictionary.take(pa.array(rest)).to_pylist()
        special = self.vocabulary.special
        split = [[w] if w in special else PIECES.findall(w) for w in texts_left]
        parts = [p for ps in split for p in ps]
        ranks = self.lexicon.rank(pa.array(parts, pa.large_string()))
        word_ids, word_starts = np.asarray(self.lexicon.ids), np.asarray(self.lexicon.starts)
        new, part_ids, part_size = self._pieces(parts, ranks, len(word_ids))
        count = np.fromiter(map(len, split), np.int64, len(split))
        part_at = np.cumsum(count) - count
        table = np.concatenate([word_ids, new])
        flat_ids = text.ragged(table, part_ids, part_size)
        size = text.sums(part_size, np.append(part_at, len(parts)))
        starts[rest] = len(table) + np.cumsum(size) - size
        lengths[rest] = size
        table = np.concatenate([table, flat_ids])
        own = text.lists(text.ragged(table, starts, lengths), np.concatenate([[0], np.cumsum(lengths)]))
        ids, at = text.gathered(own, coded.indices, np.int32)
        return ids, at[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        raw, at = text.gathered(self.bytes_of, ids, np.uint8)
        raw, at = raw.tobytes(), at[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]

    def decimal(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        raw, at = text.gathered(self.digits_of, ids, np.uint8)
        raw, at = raw.tobytes(), at[bounds].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]


def _vocabulary(path: str) -> Vocabulary:
    own = held("bpe")
    if path not in own:
        own[path] = Vocabulary(path)
    return own[path]


def _encoder(path: str, lexicon_uri: str) -> Encoder:
    own = held("bpe")
    if (path, lexicon_uri) not in own:
        for k in [k for k in own if isinstance(k, tuple)]:
            del own[k]
        own[path, lexicon_uri] = Encoder(_vocabulary(path), Lexicon.load(lexicon_uri))
    return own[path, lexicon_uri]


def _count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            table = pa.table({"w": pa.chunked_array([x[0] for x in held], pa.large_string()), "n": pa.chunked_array([x[1] for x in held], pa.int64())})
            got = table.group_by("w").aggregate([("n", "sum")]).combine_chunks()
            got = got.filter(pc.less_equal(pc.binary_length(got["w"]), WORD_BYTES))
            return pa.RecordBatch.from_arrays([got["w"].cast(pa.string()).combine_chunks(), got["n_sum"].combine_chunks()], ["word", "n"])

        for batch in batches:
            for part in text.chunks(batch.column(0)):
                found, _ = runs(part, _vocabulary(path))
                if len(found):
                    coded = found.dictionary_encode()
                    held.append((coded.dictionary, pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))))
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    if held:
                        yield emit()
                    held, size = [], 0
        if held:
            yield emit()
        text.release()

    return run


def fit_lexicon(docs: DataFrame, path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> str:
    """Count runs over all texts, compile the most frequent single pieces, and return the folder."""
    rows = docs.select(F.col(text_col).alias("text")).where("text is not null")
    counts = rows.mapInArrow(_count_words(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = frequent(written(counts, "word-counts"), size)
    vocabulary = _vocabulary(path)
    words = [w for w in top if w not in vocabulary.special and PIECES.findall(w) == [w]]
    words += [p for w in top if w not in vocabulary.special for p in PIECES.findall(w)]
    return save_lexicon(docs.sparkSession, words, path)


def frequent(counts: DataFrame, size: int) -> list[str]:
    """At most size words of counts (word, n): all those of at least some number, by eighths of a power of two.

    A few hundred sums settle that number, so no task ranks words.
    """
    level = F.floor(8 * F.log2("n")).cast("int")
    words, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        words += r["count"]
        if words > size:
            break
        least = r["level"]
    return [] if least is None else counts.where(level >= least).select("word").toArrow()["word"].to_pylist()


def save_lexicon(spark: SparkSession, words: list[str], path: str) -> str:
    vocabulary, uri = _vocabulary(path), fresh_path(spark, "lexicon")
    Lexicon.build([w.encode() for w in words], vocabulary.merge_all).save(uri)
    return uri


def coder(path: str, lexicon_uri: str):
    """A UDF of a text: struct(n_tokens, ids_sha256, decoded_sha256)."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def code(texts: pa.Array) -> pa.Array:
        own = _encoder(path, lexicon_uri)
        n, a, b = [], [], []
        for part in text.chunks(texts, ENCODE_BYTES):
            ids, bounds = own.encode(part)
            n.append(np.diff(bounds))
            a += [hashlib.sha256(x).hexdigest() for x in own.decimal(ids, bounds)]
            b += [hashlib.sha256(x.encode()).hexdigest() for x in own.decode(ids, bounds)]
        text.release()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return code


def encoded(path: str, lexicon_uri: str):
    """A UDF of a text: its ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = _encoder(path, lexicon_uri)
        got = [own.encode(part) for part in text.chunks(texts, ENCODE_BYTES)]
        return pa.concat_arrays([pa.ListArray.from_arrays(b.astype(np.int32), pa.array(i, pa.int32())) for i, b in got] or [pa.array([], pa.list_(pa.int32()))])

    return encode


def decoded(path: str):
    """A UDF of ids: their text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        kept = held("bpe")
        own = kept.get(("decoder", path)) or kept.setdefault(("decoder", path), Encoder(_vocabulary(path), Lexicon.build([], _vocabulary(path).merge_all)))
        return pa.array([None if x is None else own.decode(np.array(x, np.int64), np.array([0, len(x)]))[0] for x in ids.to_pylist()], pa.string())

    return decode


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 for every row."""
    uri = fit_lexicon(docs, path, text_col)
    got = docs.select(F.col(id_col).alias("doc_id"), coder(path, uri)(F.col(text_col)).alias("got"))
    return got.select("doc_id", "got.n_tokens", "got.ids_sha256", "got.decoded_sha256")
