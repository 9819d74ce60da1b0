"""Small hand-made cases of sites, amplicons, probes, panels, sources and sinks."""

import gzip
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from amplispark.functions import alphabet as al
from amplispark.functions import thermo
from amplispark.operators import annotate, panel
from amplispark.operators import hits as hits_module
from amplispark.operators import products as products_module
from amplispark.operators.hits import hits
from amplispark.operators.products import products, with_sequences
from amplispark.sources import fasta, sinks


def brute(seq, p, max_mm, window, low=0, high=0, circular=False):
    """All amplicons, straight from the rules."""
    def sites(pattern, protected):
        out = []
        for i in range(len(seq) - len(pattern) + 1):
            bad = [j for j, c in enumerate(pattern) if seq[i + j] not in "ACGT" or not al.MASK[seq[i + j]] & al.MASK[c]]
            if len(bad) <= max_mm and not set(bad) & set(protected):
                out.append((i, bad))
        return out

    o = panel.orientations(p)
    at = {k: sites(s, range(max(0, len(s) - window), len(s)) if k in "AB" else range(min(window, len(s)))) for k, s in o.items()}
    rows = []
    for kind, a, b in (("forward", "A", "b"), ("revcomp", "B", "a")):
        for s, fb in at[a]:
            for r, rb in at[b]:
                for wrap in (False, True):
                    n = len(o[b])
                    length = r + n - s + wrap * len(seq)
                    if (r > s if not wrap else circular and r < s) and (not low or length >= low) and (not high or length <= high):
                        rows.append((s, r + n, length, kind, len(fb), len(rb), ",".join(map(str, fb)), ",".join(str(n - 1 - j) for j in rb), wrap))
    return sorted(rows)


def found(spark, seq, p, max_mm=0, window=0, low=0, high=0, circular=False):
    rows = products(hits(spark.createDataFrame([("s", seq)], "record string, seq string"), [p], max_mm, window), [p], low, high, circular)
    return sorted(tuple(r) for r in rows.select("start", "end", "length", "type", "fwd_mm", "rev_mm", "fwd_mm_i", "rev_mm_i", "is_wrap").collect())


@pytest.mark.parametrize("max_mm,window,circular", [(0, 0, False), (1, 0, True), (1, 3, False), (2, 2, True)])
def test_products_equal_brute_force(spark, max_mm, window, circular):
    rng = random.Random(7)
    p = panel.pair("p", "ACGTAC", "GGTRCC")
    seq = "".join(rng.choice("ACGTN") for _ in range(60)) + "ACGTACTTTTGGTACC" + "".join(rng.choice("ACGT") for _ in range(60)) + "GGTACCAAACGTACGT"
    assert found(spark, seq, p, max_mm, window, 0, 90, circular) == brute(seq, p, max_mm, window, 0, 90, circular)


@pytest.mark.parametrize("max_mm,window,low,high", [(0, 0, 0, 90), (1, 0, 20, 60), (1, 3, 0, 40), (2, 2, 30, 2000)])
def test_scanned_amplicons_equal_brute_force(spark, monkeypatch, max_mm, window, low, high):
    """Straight from blocks of a few bases, several records and pairs, with bounds of the pairs' own."""
    monkeypatch.setattr(products_module, "blocks", lambda records, overlap, f=hits_module.blocks: f(records, overlap, 16))
    monkeypatch.setattr(products_module, "PAIRS_AT_ONCE", 3)
    rng = random.Random(9)
    pairs = [panel.pair("p", "ACGTAC", "GGTRCC"), panel.pair("q", "TTNA", "GCA", 8, 30)]
    seqs = {f"r{k}": "".join(rng.choice("ACGTN") for _ in range(50 * k)) + "ACGTACTTTTGGTACC" * k for k in range(4)}
    records = spark.createDataFrame(list(seqs.items()), "record string, seq string")
    got = products_module.amplicons(records, pairs, max_mm, window, low, high).collect()
    want = [(r, p.id, *x) for r, seq in seqs.items() for p in pairs for x in brute(seq, p, max_mm, window, p.min_length or low, p.max_length or high)]
    shown = [tuple(r[c] for c in ("record", "experiment_id", "start", "end", "length", "type", "fwd_mm", "rev_mm", "fwd_mm_i", "rev_mm_i", "is_wrap")) for r in got]
    assert sorted(shown) == sorted(want) and want
    assert products_module.amplicons(records.limit(0), pairs, max_mm, window, low, high).count() == 0


def test_reference_n_is_one_mismatch_and_primer_n_is_free(spark):
    assert len(found(spark, "TTTACNTACAAAAGGTACCTTT", panel.pair("p", "ACGTAC", "GGTACC"), 1)) >= 1
    assert found(spark, "TTTACNTACAAAAGGTACCTTT", panel.pair("p", "ACGTAC", "GGTACC"), 0) == []


def test_circular_product_has_the_whole_sequence(spark):
    p = panel.pair("p", "AG", "TC")
    records = spark.createDataFrame([("s", "TGACAAG")], "record string, seq string")
    rows = with_sequences(products(hits(records, [p]), [p], circular=True).where("is_wrap and type = 'forward'"), records).collect()
    assert [(r["start"], r["end"], r["seq"]) for r in rows] == [(5, 3, "AGTGA")]


def test_length_bounds_are_inclusive(spark):
    p = panel.pair("p", "ACGTAC", "GGTACC")
    seq = "TTTACGTACAAAAGGTACCTTT"
    assert found(spark, seq, p, low=16, high=16) and not found(spark, seq, p, low=17, high=100) and not found(spark, seq, p, low=1, high=15)


def test_long_records_are_cut_into_blocks_without_loss(spark, monkeypatch):
    import amplispark.operators.hits as h

    p = panel.pair("p", "ACGTAC", "GGTACC")
    seq = "ACGTACAAAGGTACCTT" * 40
    rows = spark.createDataFrame([("s", seq)], "record string, seq string")
    whole = sorted(map(str, hits(rows, [p], 1).collect()))
    cut = h.blocks(rows, 5, 16).mapInArrow(h._scan(h._patterns([p], 1, 0), 1), h.SCHEMA)
    assert sorted(map(str, cut.collect())) == whole


def test_probe_prefers_plus_when_exact_and_leftmost_otherwise(spark):
    df = spark.createDataFrame([("TTGTACCCACAATTGTGGGTACAA",)], "seq string")
    hit = df.select(annotate.probe_hit(F.col("seq"), "TTGTGGG", 0).alias("h")).first()["h"]
    assert (hit["strand"], hit["pos"]) == ("+", 12)
    hit = df.select(annotate.probe_hit(F.col("seq"), "TTGTGGG", 1).alias("h")).first()["h"]
    assert (hit["strand"], hit["pos"], hit["mm"]) == ("-", 5, 0)
    assert df.select(annotate.probe_hit(F.col("seq"), "AAAAAAAA", 0).alias("h")).first()["h"] is None


def test_nested(spark):
    rows = spark.createDataFrame([("ACGTACGTACGT",), ("AAAA",)], "seq string")
    got = {r["seq"]: r["inner_found"] for r in annotate.with_nested(rows, [panel.pair("i", "ACG", "ACG")]).collect()}
    assert got == {"ACGTACGTACGT": True, "AAAA": False}
    assert annotate.with_nested(rows, [panel.pair("i", "ACG", "ACG")], require=True).count() == 1


def test_panels():
    pairs = panel.parse_panel(["# x", "p1 ACG ACG", "p2 cgt CGT 10 20", ""])
    assert [(p.id, p.forward, p.max_length) for p in pairs] == [("p1", "ACG", 0), ("p2", "CGT", 20)]
    with pytest.raises(ValueError):
        panel.parse_panel(["p1 ACG"])
    with pytest.raises(ValueError):
        panel.pair("u", "ACU", "ACG")
    assert [p.id for p in panel.with_unique_self_pairs(pairs)] == ["p1", "p2", "p1+A:self", "p2+A:self"]


def test_melting_temperature_of_a_known_duplex(spark):
    df = spark.createDataFrame([("ATGCATGCATGC",)], "p string")
    dh = df.select(thermo.enthalpy(F.col("p"))).first()[0]
    want = 0.2 + 2.2 + sum(thermo.STACKS["ATGCATGCATGC"[i : i + 2]][0] for i in range(11))
    assert abs(dh - want) < 1e-9


def test_fasta_round(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first\r\nacgt\nAC\n>r2\n>\nAA\n>r3\tx\nTT\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nGG\n")
    got = {r["record"]: r["seq"] for r in fasta.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"r1": "ACGTAC", "r2": "", "r3": "TT", "z": "GG"}
    pieces = fasta.chunks(spark.createDataFrame([("r", "ACGTACGTACGT")], "record string, seq string"), 5, 2)
    ids = pieces.select(fasta.chunk_id(F.col("record"), F.col("at"), F.col("seq"))).collect()
    assert sorted(r[0] for r in ids) == ["r:0-5", "r:3-8", "r:6-11", "r:9-12"]


def test_sinks(spark):
    rows = spark.createDataFrame([("f", "s", "p", 0, 9, 9, "forward", 0, 1, "", "3")], "source_file string, sequence_id string, experiment_id string, start int, end int, length int, type string, fwd_mm int, rev_mm int, fwd_mm_i string, rev_mm_i string")
    assert sinks.tsv_lines(rows).first()[0] == "f\ts\tp\t0\t9\t9\tforward\t0\t1\t\t3"
    assert sinks.json_lines(rows).first()[0] == '{"experiment_id":"p","sequence_id":"s","start":0,"end":9,"length":9,"type":"forward","rev_mm":1,"rev_mm_i":[3],"source_file":"f"}'


def test_doubles_in_their_shortest_form(spark):
    values = {0.0: "0", 12.0: "12", -1.5: "-1.5", 0.25: "0.25", 0.0001: "0.0001", -0.00025: "-0.00025", 1e-5: "1e-05", 1.5e6: "1.5e+06", 2e6: "2e+06", 3.25e7: "3.25e+07", float("nan"): "NaN", float("-inf"): "-Inf"}
    rows = spark.createDataFrame([(k,) for k in values], "x double").select(sinks.shortest(F.col("x")))
    assert [r[0] for r in rows.collect()] == list(values.values())


def test_probe_and_nested_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("f", "s", "p", 0, 12, 12, "forward", 0, 0, "", "", "ACGTTTACGGGT", 1)], "source_file string, sequence_id string, experiment_id string, start long, end long, length long, type string, fwd_mm int, rev_mm int, fwd_mm_i string, rev_mm_i string, seq string, n int")
    got, none = (annotate.with_probe(rows, "x", q) for q in ("TTTAC", "GGGGG"))
    assert sinks.tsv_lines(got, sinks.PROBE).first()[0].endswith("\tx\tTTTAC\ttrue\t+\t3\t0\tTTTAC")
    assert sinks.tsv_lines(none, sinks.PROBE).first()[0].endswith("\tx\tGGGGG\tfalse\t\t\t\t")
    assert sinks.fasta_lines(got, "probe").first()[0] == ">p_1 start=0 end=12 len=12 source_file=f probe=x found=true\nACGTTTACGGGT"
    assert sinks.json_lines(none, "probe").first()[0].endswith('"source_file":"f","probe_name":"x","probe_seq":"GGGGG","probe_found":false}')
    inner = annotate.with_nested(rows, [panel.pair("i", "CGT", "CCC")])
    assert sinks.tsv_lines(inner, sinks.NESTED).first()[0] == "f\ts\tp\t0\t12\t12\tforward\ti\ttrue\t1\t11\t10\tforward\t0\t0"
    assert '"inner_found":true,"inner_experiment_id":"i","inner_start":1' in sinks.json_lines(inner, "nested").first()[0]
    with pytest.raises(ValueError):
        sinks.write(inner, str(tmp_path / "x"), "fasta", "nested")
    for format in sinks.FORMATS:
        sinks.write(got, str(tmp_path / format), format, "probe")
        assert spark.read.text(str(tmp_path / format)).count() > 0
    sinks.write(got.unionAll(got).unionAll(got), str(tmp_path / "three"), "json", "probe")
    sinks.write(got.where("false"), str(tmp_path / "none"), "json", "probe")
    for name, n in (("json", 1), ("three", 3), ("none", 0)):
        parts = sorted(p for p in os.listdir(tmp_path / name) if p.startswith("part-"))
        assert len(json.loads("".join((tmp_path / name / p).read_text() for p in parts))) == n
    sinks.write_tsv(inner, str(tmp_path / "nested"), sinks.NESTED)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "nested")).columns[2:7] == ["outer_experiment_id", "outer_start", "outer_end", "outer_length", "outer_type"]


@pytest.mark.parametrize("forward, max_mm, window", [("ACGTTA", 1, 0), ("N" * 12, 2, 0), ("N" * 10 + "AC", 0, 0), ("GNACTTACGTTAACG", 2, 14), ("ACGTTA", 1, 3), ("ACGTAACGTAAACG", 2, 0)])
def test_seed_join_equals_the_scan(spark, monkeypatch, forward, max_mm, window):
    monkeypatch.setattr(hits_module, "SEED_BASES", 16)
    seq = "TTACGTTANNACGTCACGTGACGTAGACTTACGTTAACGTRACGTAAACGTGACGTC" * 2
    rows = spark.createDataFrame([("r", seq), ("short", "AC"), ("none", "")], "record string, seq string")
    pairs = [panel.pair("p", forward, "ACGT"), panel.pair("q", "TTAACG", "GACGTC")]
    columns = ["record", "len", "pair_ord", "orient", "pos", "mm", "mm_idx"]
    got = hits_module.seed_hits(rows, pairs, max_mm, window).select(columns).collect()
    want = hits_module.hits(rows, pairs, max_mm, window).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_a_seed_is_placed_where_it_stands_for_fewest_kmers():
    assert hits_module.seed_place("NNACGTACNN", range(0), 0, 4) == (1, 2, 4)
    assert hits_module.seed_place("ACGTACGTAC", range(7, 10), 1, 4)[1] == 6  # three protected letters: fewer variants
    for seq, protected, off, k, mm in (("ACGN", range(0), 0, 4, 0), ("ACGT", range(1, 2), 0, 4, 2), ("RYN", range(0), 0, 3, 1)):
        kmers = hits_module.seed_kmers(seq, protected, off, k, mm)
        assert len(kmers) == len(set(kmers)) == hits_module.seed_size(seq, protected, off, k, mm)


def test_cap_takes_the_leftmost_over_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(hits_module, "blocks", lambda records, overlap, f=hits_module.blocks: f(records, overlap, 8))
    rows = spark.createDataFrame([("r", "ACGTTACGTACGACGTTTACG"), ("s", "ACG")], "record string, seq string")
    got = hits_module.hits(rows, [panel.pair("p", "ACG", "ACG")], cap=3, orients="A").select("record", "pos").collect()
    assert sorted(map(tuple, got)) == [("r", 0), ("r", 5), ("r", 9), ("s", 0)]


def test_sequences_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(products_module, "SEQUENCE_BLOCK", 7)
    monkeypatch.setattr(products_module, "SEQUENCE_MORE", 3)
    seq = "ACGTTACGTACGACGTTTACGAAC"
    records = spark.createDataFrame([("r", seq), ("s", "")], "record string, seq string")
    rows = [("r", 0, a, b, b - a, "forward", False) for a in range(len(seq)) for b in range(a + 1, len(seq) + 1)]
    rows += [("r", 0, a, b, len(seq) - a + b, "forward", True) for a in range(1, len(seq)) for b in range(1, a)]
    df = spark.createDataFrame(rows, "record string, pair_ord int, start long, end long, length long, type string, is_wrap boolean")
    got = with_sequences(df, records).collect()
    assert len(got) == len(rows)
    assert all(r["seq"] == (seq[r["start"] :] + seq[: r["end"]] if r["is_wrap"] else seq[r["start"] : r["end"]]) for r in got)


def test_places_in_the_whole_and_within_records(spark):
    rows = [(f"r{i % 3}", i * 7919 % 101, 5 + i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "record string, start long, end long").repartition(5)
    order = [F.col("record"), F.col("start"), F.col("end")]
    got = sorted((r["n"], r["record"], r["start"], r["end"]) for r in products_module.numbered(df, order).collect())
    assert [x[1:] for x in got] == sorted(rows) and [x[0] for x in got] == list(range(1, 61))
    for r in products_module.ranked(df, order[1:]).collect():
        assert r["rank"] == 1 + sorted(x[1:] for x in rows if x[0] == r["record"]).index((r["start"], r["end"]))
    assert products_module.numbered(df.limit(0), order).count() == 0


def test_files_with_equal_ids_stay_apart_when_deduplicated(spark):
    row = ("r", 0, 1, 9, "forward", False)
    df = spark.createDataFrame([("a", *row), ("a", *row), ("b", *row)], "source_file string, record string, pair_ord int, start long, end long, type string, is_wrap boolean")
    assert products_module.deduplicated(df).count() == 2 and products_module.deduplicated(df.drop("source_file")).count() == 1


def test_fasta_odd_files(spark, tmp_path):
    (tmp_path / "lead.fa").write_text("ACGT\nGGTT\n>r1 x\nac gt\n\n>r2\nAA>A\n")
    with gzip.open(tmp_path / "zipped.fa", "wt") as f:  # told by its first bytes, not by its name
        f.write(">z\nGG\n")
    (tmp_path / "empty.fa").write_text("")
    (tmp_path / "none.fa").write_text("ACGT\n")
    got = sorted((r["record"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "*.fa")).collect())
    assert got == [("r1", "AC GT"), ("r2", "AA>A"), ("z", "GG")]
    with pytest.raises(FileNotFoundError):
        fasta.read_fasta(spark, str(tmp_path / "*.no"))


def test_fasta_splits_lose_no_record():
    text = b"lead\n" + b"".join(b">r%d x\nACGT\nAC\n" % i for i in range(40)) + b">last"
    for data in (text, text[5:], text + b"\n", b">a\n>b\n>c"):
        want = [x.split(b"\n", 1)[0] for x in (b"\n" + data).split(b"\n>")[1:]]
        for step in (1, 2, 3, 7, 50, 10_000):
            got = []
            for at in range(0, len(data), step):
                for size in (1, 4, 1 << 20):
                    f = io.BytesIO(data)
                    f.seek(max(at - 1, 0))
                    found = list(fasta.bodies(lambda n, f=f, size=size: f.read(min(n, size)), at, at + step))
                got += found
            assert [x.split(b"\n", 1)[0] for x in got] == want


def test_fasta_from_standard_input(spark, monkeypatch):
    class In:
        buffer = io.BytesIO(b">s one\nac\ngt\n>t\nTT")

    monkeypatch.setattr("sys.stdin", In)
    got = fasta.read_fasta(spark, "-").collect()
    assert [(r["source_file"], r["record"], r["seq"]) for r in got] == [("-", "s", "ACGT"), ("-", "t", "TT")]


def test_wrapped_chunks_and_chunk_policy(spark):
    rows = spark.createDataFrame([("r", "ACGTACGTAC"), ("s", "ACG")], "record string, seq string")
    got = sorted(tuple(r) for r in fasta.wrapped_chunks(rows, 4).collect())
    assert got == [("r", 0, "ACGT", False, False), ("r", 4, "ACGT", False, False), ("r", 6, "GTAC", True, True), ("r", 8, "AC", False, False), ("s", 0, "ACG", False, True)]
    assert sorted(tuple(r)[1:] for r in fasta.wrapped_chunks(rows, 4, False).where("record = 'r'").collect()) == [(0, "ACGT", False, False), (4, "ACGT", False, False), (8, "AC", False, True)]
    assert fasta.wrapped_chunks(rows, 0).where("is_last").count() == 2
    assert fasta.chunk_policy(1000, 200, 20) == (1000, 200, "") and fasta.chunk_policy(0, 200, 20) == (0, 0, "")
    assert all(fasta.chunk_policy(*x)[:2] == (0, 0) and fasta.chunk_policy(*x)[2] for x in ((1000, 0, 20), (100, 100, 20), (1000, 200, 20, True)))


def test_letters_match_if_they_share_a_base(spark):
    assert al.matches("R", "g") and al.matches("n", "T") and not al.matches("R", "Y") and not al.matches("U", "T")
    pairs = spark.createDataFrame([("R", "g"), ("R", "Y"), ("U", "T"), (None, "A")], "p string, g string")
    assert [r[0] for r in pairs.select(al.matches_letters(F.col("p"), F.col("g"))).collect()] == [True, False, False, False]


def test_probe_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "seq string")
    for probe, mm in (("ACG", 0), ("ACG", 1), ("ARN", 0), ("ACGTA", 2)):
        plus = mm == 0 and not set(probe) - set("ACGT")
        for r in df.withColumn("h", annotate.probe_hit(F.col("seq"), probe, mm)).collect():
            found = []
            for strand, pattern in ((0, probe), (1, al.reverse_complement(probe))):
                for i in range(len(r["seq"] or "") - len(probe) + 1):
                    bad = sum(r["seq"][i + j] not in al.BASES[c] for j, c in enumerate(pattern))
                    if bad <= mm:
                        found.append((bad, strand if plus else 0, i, strand))
            h = r["h"]
            assert (h is None) == (not found)
            if found:
                bad, _, i, strand = min(found)
                assert (h["mm"], h["pos"], h["strand"], h["site"]) == (bad, i, "+-"[strand], r["seq"][i : i + len(probe)])
