"""Cases that single operators have to handle: far and huge vectors, files and their insides, long texts, repeats, ties, odd columns."""

import glob
import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from amplispark.llm import ann, bpe, contamination, html, license_scan, orc_tokens, queries, simhash, warc

from . import brute

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def nearest(x, q, ids, k=10):
    scale = np.abs(x).max() or 1
    d = np.sqrt((((x - x[q]) / scale) ** 2).sum(1)) * scale
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order]


@pytest.mark.parametrize("offset, spread", [(0.0, 1.0), (1e5, 1e-3), (1e6, 1e-2), (0.0, 1e160), (0.0, 1e-170), (-3e150, 1e140)])
def test_neighbours_at_any_offset_and_size(spark, offset, spread):
    x = offset + spread * np.random.default_rng(1).normal(size=(300, 16))
    x[7] = x[0]
    ids = np.arange(300)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("own") for c in ("id", "v", "code", "key", "d", "score", "rank", "label")})
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).collect()
    hit = 0
    for q in (0, 100, 200):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = nearest(x, q, ids)
        assert len(mine) == 10
        hit += len({m[1] for m in mine} & {i for i, _ in want})
        for _, i, s in mine:
            assert s == pytest.approx(dict(nearest(x, q, ids, 299))[i], rel=1e-9)
    assert hit >= 27
    assert [r["vec_id"] for r in got if r["query_id"] == 0 and r["rank"] == 1] == [7]


def test_neighbours_of_one_large_group(spark, monkeypatch):
    """A third of all rows alike, and blocks of a few rows: ties go to the smaller ids, and rows of one id count once."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i), 1.0, 0.5]) for i in range(120)]
    df = spark.createDataFrame(rows + rows[:60] + [(3, [50.0, 1.0, 0.5])], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 60 = 0")).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0) == [(k, 3 * k) for k in range(1, 11)]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for offset, spread in ((0, 1), (1e8, 1e-4), (0, 1e200), (0, 1e-200)):
        x = offset + spread * rng.normal(size=(40, 9))
        centre = x.mean(0)
        code = ann.rounded(x, centre)[1]
        low, high = ann.bounds(code, code)
        scale = np.abs(x).max()
        exact = np.sqrt((((x[:, None] - x[None]) / scale) ** 2).sum(2)) * scale
        assert (low <= exact * (1 + 1e-9)).all() and (high >= exact * (1 - 1e-9)).all()


def token_rows(spark, n):
    return spark.createDataFrame([(i, f"word{i} the and of number {i}") for i in range(n)], "doc_id long, text string")


def test_stripes_indexes_bloom_filters_and_run_lengths(spark, tmp_path):
    orc_tokens.write_tokens(token_rows(spark, 5000), queries.tokenizer_path(WORD), f"{tmp_path}/t", parts=2)
    orc, hadoop = spark._jvm.org.apache.orc.OrcFile, spark._jsc.hadoopConfiguration()
    for file in glob.glob(f"{tmp_path}/t/part-*.orc"):
        reader = orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(hadoop))
        rows = reader.rows()
        assert reader.getRowIndexStride() == orc_tokens.INDEX_ROWS and reader.getStripes().size() >= 1
        footer = rows.readStripeFooter(reader.getStripes().get(0))
        kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
        encodings = [e.getKind().toString() for e in footer.getColumnsList()]
        assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds
        assert encodings[1] == encodings[2] == encodings[4] == "DIRECT_V2"  # integers by run lengths
        rows.close()


def test_a_read_of_one_document_skips_the_others(spark, tmp_path):
    orc_tokens.write_tokens(token_rows(spark, 5000), queries.tokenizer_path(WORD), f"{tmp_path}/t", parts=1)
    df = orc_tokens.read_tokens(spark, f"{tmp_path}/t").where("doc_id = 4321")
    got = df.collect()
    assert len(got) == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4321)]" in plan
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    read = [leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())]
    assert sum(read) <= orc_tokens.INDEX_ROWS


def test_files_go_by_their_number(spark):
    tokens = spark.createDataFrame([("part-100000-a.orc", [1]), ("part-99999-b.orc", [1, 2]), ("part-00003-c.orc", [4, 5, 6])], "file string, ids array<int>")
    assert {r["file"][:10]: r["base"] for r in orc_tokens.file_starts(tokens).collect()} == {"part-00003": 0, "part-99999": 3, "part-10000": 5}


def test_tokens_of_repeated_and_null_ids(spark):
    whole = Tokenizer.from_file(queries.tokenizer_path(WORD))
    texts = [(None, "a b"), (None, "c"), (5, "x y z"), (5, "x y z"), (5, "long " * 30_000), (-3, None), (2, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("ids", "before", "file", "start", "base")})
    got = orc_tokens.token_table(df, queries.tokenizer_path(WORD)).collect()
    size = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is not None, i or 0, size(t)) for i, t in texts)
    placed = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert [s for s, _, _ in placed] == list(np.cumsum([0, *(n for _, n, _ in placed)])[:-1])
    ids = [i for _, _, i in placed]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_encoding_repeats_and_very_long_words(spark):
    path = queries.tokenizer_path(BYTE)
    whole = Tokenizer.from_file(path)
    texts = ["A" * 60_000, "same text", "same text", "é" * 5000 + " end", " " * 20_000, None, "tail\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("own") for c in ("got", "n_tokens", "word", "n")})
    for r in bpe.round_trip(df, path).collect():
        ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    own = df.select("doc_id", bpe.encoded(path, bpe.save_lexicon(spark, ["same", " text"], path))("text").alias("ids"))
    back = {r["doc_id"]: r["t"] for r in own.select("doc_id", bpe.decoded(path)("ids").alias("t")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i}", i + 1) for i in range(100)], "word string, n long")
    for size in (0, 1, 5, 37, 100, 1000):
        got = bpe.frequent(counts, size)
        numbers = sorted(int(w[1:]) for w in got)
        assert len(got) <= size and numbers == list(range(100 - len(numbers), 100))
    assert len(bpe.frequent(counts, 1000)) == 100 and bpe.frequent(counts.limit(0), 5) == []


def test_contamination_of_long_texts_and_frequent_words(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    long = "the cat " * 40_000 + item + " the" * 40_000
    rows = [(1, long), (2, "the"), (3, None), (1, "cat"), (1, "cat"), (None, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("h", "pos", "w", "shingle", "copies", "n_words", "id")})
    items = spark.createDataFrame([(1, item), (2, "the"), (3, "the")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in contamination.contamination(df, items).collect())
    assert got == [(0, 11, 11, 1), (1, 1, 0, 0), (1, 1, 0, 0), (1, 120_011, 80_011, 3), (2, 1, 1, 2), (3, 0, 0, 0)]


def test_fingerprints_of_long_texts_and_heavy_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 5)
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(30_000))
    texts = [long, long + " end", "A" * 50_000, *["the same text of many rows"] * 20, "", None, "é " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("own") for c in ("fp", "fp2", "component", "least", "root", "rows", "fingerprint")})
    fps = [brute.fingerprint(t) for t in texts]
    root = brute.roots(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
    assert got == {i: (f"{f:016x}", root[i]) for i, f in enumerate(fps)}


def page_rows(spark, n=300):
    rows = [(i, f"http://h/{i}", ("y" * 1500 if i % 7 == 0 else f"page {i} " * (3 if i % 2 else 4000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def reader(path, payload=True, **wanted):
    r = warc.WarcReader(path, payload)
    r.wanted = {k: set(v) for k, v in wanted.items()}
    return r, [x for s in r.partitions() for b in r.read(s) for x in b.to_pylist()]


def test_unwanted_records_are_not_inflated(spark, tmp_path):
    rows, df = page_rows(spark)
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path)
    whole, found = reader(path)
    assert len(found) == len(rows) and whole.inflated > sum(len(h) for _, _, h in rows) - 300 * 1500
    one, found = reader(path, page_id=[150])
    assert [x["page_id"] for x in found] == [150] and one.skipped == len(rows) - 1
    assert one.inflated <= len(rows) * warc.PEEK + 4000 < whole.inflated
    heads, found = reader(path, payload=False)
    assert len(found) == len(rows) and all(x["payload"] is None for x in found) and heads.inflated < whole.inflated / 2


def test_splits_give_each_record_once(spark, tmp_path, monkeypatch):
    rows, df = page_rows(spark, 120)
    path = f"file://{tmp_path}/w"
    warc.write_warc(df.coalesce(1), path)
    want = sorted(x["page_id"] for x in reader(path)[1])
    for size in (100, 333, 5000):
        monkeypatch.setattr(warc, "SPLIT_BYTES", size)
        assert sorted(x["page_id"] for x in reader(path)[1]) == want


def test_each_record_is_a_gzip_member_of_its_own(spark, tmp_path):
    rows, df = page_rows(spark, 20)
    warc.write_warc(df.coalesce(1), f"file://{tmp_path}/w")
    (file,) = glob.glob(f"{tmp_path}/w/part-*.warc.gz")
    raw, n = open(file, "rb").read(), 0
    while raw:
        z = zlib.decompressobj(31)
        assert z.decompress(raw).startswith(b"WARC/1.1\r\n") and z.eof
        assert int.from_bytes(raw[16:20], "little") == len(raw) - len(z.unused_data)
        raw, n = z.unused_data, n + 1
    assert n == 20
    open(f"{tmp_path}/w/part-stray.warc.gz", "wb").write(b"left by a lost task")  # not in the manifest
    assert len(reader(f"file://{tmp_path}/w")[1]) == 20


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    text = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:7>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.warc").write_bytes(text * 2)
    (tmp_path / "f/b.warc.gz").write_bytes(gzip.compress(text) + gzip.compress(text))
    df = warc.read_warc(spark, f"file://{tmp_path}/f")
    assert [bytes(r["payload"]) for r in df.where("record_type = 'response'").collect()] == [b"hello"] * 4
    assert df.where("page_id = 8").count() == 0


def test_warc_repeats_and_long_pages(spark):
    big = "é" * 400_000
    rows = [(1, "u", big), (2, "u", big), (2, "u", big), (3, None, "x\r\n\r\ny"), (3, None, "x\r\n\r\ny")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("payload", "digest", "top", "refers_to", "record_type")})
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.archived(df).collect())
    assert got == [(1, 800_000, "revisit", 2), (2, 800_000, "response", 0), (2, 800_000, "response", 0), (3, 6, "response", 0), (3, 6, "response", 0)]


@pytest.mark.parametrize("page, want", [
    ("<form><article><p>hello big world of text</p></article></form>", "hello big world of text"),
    ("<article><p class='share-price'>one two three</p><div class='related-work'>four five</div><div class='search results'>six seven</div></article>", "one two three four five six seven"),
    ("<article><a href=x>all of this is a link</a></article>", "all of this is a link"),
    ("<div class=ad>no</div><p>yes yes</p><div class='cookie-notice'>we use cookies</div><div id='post-comments'><p>great post</p></div>", "yes yes"),
    ("<div class='page sidebar-right'><h1>Title here</h1><p>the whole text of the page</p></div>", "Title here the whole text of the page"),
    ("<article><header><h1>Head</h1></header><p>text of it</p><footer>by me</footer></article>", "Head text of it"),
    ("<nav>a<article><p>teaser text</p></article></nav><article><p>the one</p></article>", "the one"),
    ("<p>one <svg><text>hidden</text></svg>two <select><option>x</select>three</p>", "one two three"),
    ("<head><title>t<body><p>lost</p>", ""),
    ("<head><meta x><body><p>the text</p>", "the text"),
    ("<p>a<!-- <p>no</p> -->b</p><!-- open", "ab"),
    ("<p title='a > b'>kept</p>", "kept"),
    ("<p>1 < 2 and <b>x</b></p>", "1 < 2 and x"),
    ("<div class='share'><a href=1>Tweet</a> <a href=2>Pin</a></div><p>some text of the page</p>", "some text of the page"),
])
def test_main_text_of_hand_made_pages(page, want):
    assert html.extract(page, {}) == want


def test_main_text_takes_linear_time():
    for page in ('<p>hello world</p><a ' + '"' * 1_000_000 + "<b>x</b>", "<a '\"=\"'" * 100_000, "<div>" * 100_000 + "x", "<head>" * 100_000, "</div>" * 50_000 + "<a>" * 50_000, "<!" * 300_000, "<a ='" * 200_000, "<script>" * 100_000):
        began = time.perf_counter()
        html.extract(page, {})
        assert time.perf_counter() - began < 5


def test_main_text_repeats_ties_long_pages_and_clashing_columns(spark):
    pages = ["<p>tie one</p><nav>" + "x " * 50 + "</nav><p>tie two</p>", "<article><p>" + "long text " * 50_000 + "</p></article>", None]
    rows = [(i, f"u{i}", p) for i, p in enumerate(pages)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("text", "n_chars", "feature", "h")})
    got = sorted((r["page_id"], r["n_chars"]) for r in html.main_text(df).collect())
    assert got == sorted((i, n) for i, n in enumerate((15, 499_999, 0)) for _ in range(2))
    assert html.best_region([1.0, -5.0, 1.0]) == (0, 1)


def test_spark_names_that_clash_with_license_columns(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("got", "n_blocks", "licenses", "n_diff")})
    assert license_scan.scan_licenses(df).first()["licenses"] == "MIT"
