"""Language identification: multinomial naive Bayes over hashed character n-grams.

Words are cut at ASCII white space, lower-cased and given a boundary mark at
either end; their n-grams of one to four characters are hashed to a fixed
number of buckets. Counts come from all rows that may be learned from. The
matrix of log probabilities has buckets times languages entries, so its size
doesn't depend on the rows, and it is broadcast.

Nulls and edge cases: a null text, or one without a letter, is `und` with score
0. Rows with a null language are not learned from. A null doc_id is not held
out. More than MOST_LANGUAGES values of the language are an error. If nothing can be learned, all is `und`. Repeated rows and ties are
handled alike: a tie goes to the language that sorts first. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

#: Languages at most: the matrix of BUCKETS rows by languages is broadcast.
MOST_LANGUAGES = 500
#: Characters whose n-grams a worker holds at once.
SLICE_CHARACTERS = 1 << 16
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
SMOOTHING = 0.5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def ngrams(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and the words' n + 1 bounds among them."""
    lowered = pc.utf8_lower(words)
    size = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(size)
    marked = "".join(f" {w} " for w in lowered.to_pylist())
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    room = np.repeat(ends, size) - np.arange(len(points))
    h = np.zeros(len(points), np.uint64)
    out, of = [], []
    for n in ORDERS:
        h = (h[: len(points) - n + 1] * np.uint64(1_000_003) + points[n - 1 :] + np.uint64(n)) if n > 1 else points + np.uint64(1)
        ok = np.flatnonzero(room[: len(h)] >= n)
        out.append((((h[ok] * MULTIPLIER) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
        of.append(ok)
    word = np.repeat(np.arange(len(size)), size)
    of = word[np.concatenate(of)]
    order = np.argsort(of, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(of[order], np.arange(len(size) + 1))


def _slices(words: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of words of about SLICE_CHARACTERS, and where they begin."""
    at = 0
    for part in text.chunks(words, SLICE_CHARACTERS):
        yield at, part
        at += len(part)


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang in batch.column(1).unique().to_pylist():
                texts = batch.column(0).filter(pc.equal(batch.column(1), lang))
                mine = total.setdefault(lang, np.zeros(buckets, np.int64))
                for part in text.chunks(texts):
                    coded = text.words(*text.flat(part))[0].dictionary_encode()
                    if not len(coded):
                        continue
                    seen = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    for at, some in _slices(coded.dictionary):
                        grams, bounds = ngrams(some, buckets)
                        mine += np.bincount(grams, np.repeat(seen[at : at + len(some)], np.diff(bounds)), buckets).astype(np.int64)
            text.release()
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix (buckets + 1, languages) of log probabilities, the last row the log priors."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows_of = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(rows_of) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different values of {lang_col}")
    counts = rows.mapInArrow(_counted(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most buckets times MOST_LANGUAGES rows
    langs = sorted(rows_of)
    model = np.full((buckets + 1, len(langs)), SMOOTHING)
    place = {x: i for i, x in enumerate(langs)}
    column = np.array([place[x] for x in got["lang"].to_pylist()], np.int64)
    model[got["bucket"].to_numpy(), column] += got["n"].to_numpy()
    model[:-1] = np.log(model[:-1] / model[:-1].sum(0)) if langs else 0
    model[-1] = np.log(np.array([rows_of[x] for x in langs]) / max(1, sum(rows_of.values())))
    return langs, model.astype(np.float32)


def scores(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """Log probability of each text under each language."""
    out = [np.empty((0, model.shape[1]))]
    for part in text.chunks(texts):
        found, bounds = text.words(*text.flat(part))
        if not len(found):
            out.append(np.zeros((len(part), model.shape[1])))
            continue
        coded = found.dictionary_encode()
        of_word = []
        for _, some in _slices(coded.dictionary):
            grams, at = ngrams(some, len(model) - 1)
            of_word.append(text.sums(model[grams].astype(np.float64), at))
        of_word = np.concatenate(of_word)
        out.append(text.sums(of_word[coded.indices.to_numpy()], bounds))
    return np.concatenate(out) + model[-1]


def n_grams(texts: pa.Array) -> np.ndarray:
    """Number of n-grams of each text."""
    out = [np.zeros(0)]
    for part in text.chunks(texts):
        found, bounds = text.words(*text.flat(part))
        size = pc.utf8_length(found).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        out.append(text.sums(sum(np.maximum(size - n + 1, 0) for n in ORDERS).astype(np.float64), bounds) if len(found) else np.zeros(len(part)))
    return np.concatenate(out)


def predictor(langs: list[str], model: np.ndarray, docs: DataFrame):
    """A UDF of a text that gives struct(lang, score, fit): fit is the log probability of an n-gram, to three places."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    @F.arrow_udf("lang string, score double, fit double")
    def predict(texts: pa.Array) -> pa.Array:
        names, matrix = shared.value
        lang, score, fit = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
        some = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if names and some.any():
            logs = scores(texts, matrix)[some]
            best = logs.argmax(1)
            lang[some] = np.array(names, object)[best]
            score[some] = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            fit[some] = np.round((logs.max(1) - matrix[-1][best]) / np.maximum(n_grams(texts.filter(pa.array(some))), 1), 3)
        text.release()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(fit, mask=np.isnan(fit))], ["lang", "score", "fit"])

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score for every row; learned from the rows that aren't held out."""
    langs, model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    got = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predictor(langs, model, docs)(F.col(text_col)).alias("got"))
    return got.select("doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))
