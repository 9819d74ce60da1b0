"""Whole operators and the pipeline against their definitions, over small tables with odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from amplispark.llm import html, language, quality, queries

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [(9001, None, "en"), (9002, "", "de"), (None, "the house of the man", "en"), (9003, "word " * 3000, "fr"), (9004, "\x00\x01 é 日本語 🙂", None), (9004, "other text of one id", "en"), (9005, "1234 !!", "es")]


@pytest.fixture(scope="module")
def rows(spark):
    """A part of the documents with odd and repeated rows, and extra columns with names that operators use."""
    got = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    return got + ODD + got[:3] + ODD[:2]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return df.withColumns({x: F.lit(f"own {x}") for x in ("perplexity", "threshold", "keep", "got", "score", "fp", "mark", "language", "lang_pred", "id", "gone_id")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (9001, None), (9003, 1), (9003, 0)], "doc_id long, quality long"))


def test_quality(rows, docs, labels):
    shown = lambda x: None if x is None else f"{x:.4g}"
    want = [str((i, lang, shown(p), shown(h), k)) for (i, _, lang), (p, h, k) in zip(rows, brute.judged(rows, [tuple(r) for r in labels.collect()]), strict=True)]
    got = quality.quality(docs, labels)
    assert sorted(str((r["doc_id"], r["lang"], shown(r["perplexity"]), shown(r["threshold"]), r["keep"])) for r in got.collect()) == sorted(want)
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum("True" in x for x in want)


def test_quality_of_long_texts_in_pieces(spark, monkeypatch):
    texts = ["the cat sat on the mat. " * 400, "a hat", "", None, "é" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = quality.Model(quality.train(df))
    import pyarrow as pa

    want = quality.perplexities(pa.array(texts), model)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 64)
    monkeypatch.setattr(quality, "GROUP_BYTES", 200)
    monkeypatch.setattr(quality, "KEPT_ROWS", 10)
    model.held.clear()
    np.testing.assert_allclose(quality.perplexities(pa.array(texts), model), want, rtol=1e-9)
    exact = brute.KneserNey([t for t in texts if t])
    np.testing.assert_allclose(want[[0, 1, 4]], [exact.perplexity(texts[k]) for k in (0, 1, 4)], rtol=1e-5)


def test_language(rows, docs):
    want = sorted((str(i), h, lang, round(s, 4)) for (i, _, _), (h, lang, s, _) in zip(rows, brute.languages(rows), strict=True))
    got = language.identify(docs)
    assert sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 4)) for r in got.collect()) == want
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_language_slices_and_ties(spark, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("one two three", "a"), ("one two three", "b"), ("vier fünf", "c")] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(map(tuple, language.identify(df).collect()))
    assert {x[2] for x in want if "one two" in rows[x[0]][1]} <= {"a", "b"}
    even = spark.createDataFrame([(4, "one two", "b"), (5, "one two", "a")], "doc_id long, text string, lang string")
    if not any(brute.held_out(i) for i in (4, 5)):
        assert {r["lang_pred"] for r in language.identify(even).collect()} == {"a"}  # a tie goes to the first by name
    import pyarrow as pa

    langs, model = language.fit(df)
    texts = pa.array([t for _, t, _ in rows] + ["x " * 5000])
    whole = language.scores(texts, model)
    monkeypatch.setattr(language, "SLICE_CHARACTERS", 3)
    np.testing.assert_allclose(language.scores(texts, model), whole)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language.fit(df)


def test_pipeline(spark, rows, docs, labels, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    items = [(1, " ".join(rows[7][1].split()[:14])), (2, None), (None, "the house")]
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left = [r for r, (_, _, keep) in zip(rows, brute.judged(rows, [tuple(r) for r in labels.collect()]), strict=True) if keep]
    found = brute.languages(left)
    least = {}
    for lang in {x[1] for x in found}:
        fits = [f for (_, _, own), (held, pred, _, f) in zip(left, found, strict=True) if not held and own == lang == pred]
        least[lang] = brute.quantile(fits, corpus_pipeline.LANGUAGE_FIT)
    left = [r for r, (_, lang, score, fit) in zip(left, found, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE and least.get(lang) is not None and fit >= least[lang]]
    fps = [brute.fingerprint(t) for _, t, _ in left]
    groups = {}
    for (i, t, lang), fp, root in zip(left, fps, brute.roots(fps), strict=True):
        signed = fp - (1 << 64) if fp >> 63 else fp
        best = groups.setdefault(root, (i is None, i, signed, t, lang))
        groups[root] = min(best, (i is None, i, signed, t, lang), key=lambda x: (x[0], x[1] or 0, x[2]))
    left = [(i, t) for _, i, _, t, _ in groups.values() if not brute.contaminated(t, [x for x in items if x[0] is not None])]
    whole, want = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), []
    for i, t in left:
        ids = whole.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), brute.digest(",".join(map(str, ids)).encode()), brute.digest(whole.decode(ids, skip_special_tokens=False).encode())))
    got = corpus_pipeline.run(spark, folder)
    assert len(want) > 50 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_pipeline_of_nothing(spark, docs, labels, tmp_path):
    for name, df in (("documents", docs), ("labels", labels)):
        df.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0


def test_best_region_equals_all_regions():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 12):
        for _ in range(40):
            scores = rng.integers(-3, 4, n).astype(float).tolist()
            sums = [(round(-sum(scores[a:b]), 9), a, b) for a in range(n) for b in range(a + 1, n + 1)]
            best = min((s for s in sums if s[0] < 0), default=None)
            first, end = html.best_region(scores)
            assert round(sum(scores[first:end]), 9) == (-best[0] if best else 0)
            if best:  # the first, then the shortest
                ends = [b for s, a, b in sums if s == best[0]]
                assert end == min(ends)
