"""Plans and functions whose cost has to grow no faster than the input."""

import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from amplispark.functions import batched, duplex, structure, thermo
from amplispark.functions.thermo import Conditions
from amplispark.operators import hits as hits_module
from amplispark.operators import panel, scoring
from amplispark.operators.products import amplicons, with_sequences


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


RECORDS = [("a", "ACTAGCNNACTAGCACTAGCTTACTAGCTGACTAGT"), ("b", "ACTAGC" + "ACGTN" * 30 + "GCTAGT"), ("c", ""), ("d", "NNNN")]
PAIR = panel.pair("p", "ACTAGC", "ACTNGC")


def sites(spark):
    rows = spark.createDataFrame(RECORDS, "record string, seq string")
    return scoring.with_primers(amplicons(rows, [PAIR], 1, 0, 0, 90, sequences=True), [PAIR])


def test_bases_come_from_the_scan(spark):
    rows = spark.createDataFrame(RECORDS, "record string, seq string")
    got = amplicons(rows, [PAIR], 1, 0, 0, 90, sequences=True)
    want = with_sequences(amplicons(rows, [PAIR], 1, 0, 0, 90), rows)
    assert "Exchange" not in plan(got) and got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 5


def test_scores_and_policies_are_not_shuffled(spark):
    for rows in (scoring.scored(sites(spark)), scoring.by_policy(sites(spark), "mean"), scoring.older_score(sites(spark), "auto")):
        assert "Shuffle" not in plan(rows) and "hashpartitioning" not in plan(rows)


def test_distinct_rows_give_all_rows_back():
    a, b = pa.array(["x", None, "x", "", "y"]), pa.array([1.0, 1.0, 1.0, None, 2.0])
    rows, of = batched.distinct_rows([a, b])
    assert len(rows) == 4 and [rows[k] for k in of.to_pylist()] == list(zip(a.to_pylist(), b.to_pylist()))


def test_sums_of_odd_sequences(spark):
    rows = ["ACGT", "A", "S", "N", "", None, "ACNT", "GGGG", "ACGTACGTACGTTTTAAACC"]
    got = spark.createDataFrame([(x,) for x in rows], "s string").select(thermo.neighbours(F.col("s")).alias("n")).collect()
    for x, r in zip(rows, got, strict=True):
        if x is None or x == "ACNT":
            assert r.n.h is None and r.n.s is None
        elif len(x) > 1:
            assert (r.n.h, r.n.s) == pytest.approx(thermo.sums_of(x), abs=1e-9)
    assert [r.n.own for r in got] == [True, False, True, True, True, None, False, False, False]


def test_gaps_of_rows_of_any_letters(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("ACGT", k=n + d)), rng.choice((0.0, 150.0, 200.0))) for n in (1, 3, 9) for d in (-1, 0, 1) for _ in range(6)]
    df = spark.createDataFrame(rows, "p string, t string, d double").select("*", scoring.gapped_penalty(F.col("p"), F.col("t"), F.col("d")).alias("got"))
    for r in df.collect():
        assert r.got == pytest.approx(scoring.gapped_of(r.p, r.t, r.d), abs=1e-9), r


def test_an_ensemble_has_all_candidates():
    """More than 256, the strongest of them not among the first."""
    seq = "AT" * 8 + "GCGCGCGC"
    got = structure.structures_of("self-dimer", "ensemble", [(seq, None)])
    each = list(structure._Strands("self-dimer", seq, seq, Conditions()).all())
    rt = thermo.GAS / 1000 * (Conditions().anneal_c + 273.15)
    assert got["candidates"][0] == len(each) > 256
    assert got["tm"][0] == pytest.approx(min(each, key=lambda x: x.dg).tm)
    assert got["dg"][0] == pytest.approx(-rt * math.log(sum(math.exp(-x.dg / rt) for x in each)))


@pytest.mark.parametrize("kind, mode", list(itertools.product(structure.KINDS, structure.MODES)))
def test_structures_of_many_equal_one_by_one(kind, mode):
    rng = random.Random(2)
    pairs = [tuple("".join(rng.choices(letters, k=rng.choice((1, 4, 8, 11, 12, 20, 26)))) for _ in "ab") for letters in ("ACGT", "AT", "CG") for _ in range(12)]
    pairs += [("A" * 20, "T" * 20), (None, "A"), ("ACGN", "ACG"), ("", "")]
    for c in (Conditions(), Conditions(model="owczarzy08")):
        got = structure.structures_of(kind, mode, pairs, c)
        for k, (a, b) in enumerate(pairs):
            want = structure.structure(kind, mode, a, b, c)
            assert got["found"][k] == (want is not None), (a, b)
            for f, _ in structure.FIELDS if want else ():
                assert got[f][k] == pytest.approx(getattr(want, f), abs=1e-7), (a, b, f)


def test_doubles_of_lines_equal_the_column(spark):
    from amplispark.sources.sinks import shortest, shortest_of

    rng = random.Random(4)
    values = [0.0, -0.0, 12.0, 0.1, 1e-4, 0.00012, 9.9e-5, 1e-5, 999999.5, 1e6, 1.5e6, 12345678.25, 1e7, 1.5e22, -3e-30, float("nan"), float("inf"), float("-inf"), 100.0, 123456.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", shortest(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got if r.t != shortest_of(r.x)] == []


@pytest.mark.parametrize("at_most, table", [(0, 1 << 20), (500_000, 1 << 20), (500_000, 0)])
def test_ways_of_the_seed_join_agree(spark, monkeypatch, at_most, table):
    """Seeds in DataFrame operations, by a table of all k-mers, and by a search among theirs."""
    monkeypatch.setattr(hits_module, "BROADCAST_KMERS", at_most)
    rows = spark.createDataFrame([("r", "TTACGTTANNACGTCACGTGACGTAGACTTACGTTAACGTRACGTAAACGTGACGTC" * 3), ("s", "AC"), ("t", "ACGTTA")], "record string, seq string")
    pairs = [panel.pair("p", "ACGTTA", "ACNT"), panel.pair("q", "TTAACGNA", "GACGTC")]
    got = hits_module.seed_hits(rows, pairs, 1, 2)
    assert ("Join" in plan(got)) == (at_most == 0)
    assert sorted(map(str, got.collect())) == sorted(map(str, hits_module.hits(rows, pairs, 1, 2).collect()))
    tables = {4: [(x, 0, "A", 0, ["A", "C", "G", "T"], 0, 0) for x in hits_module.seed_kmers("ACGT", range(0), 0, 4, 1)]}
    monkeypatch.setattr(hits_module, "TABLE_KMERS", table)
    seeds = hits_module._Seeds(4, tables[4])
    place, number = seeds.found(hits_module.FIVE[list(b"ACGTNACCTACG")])
    assert place.tolist() == [0, 5] and number.tolist() == [0, 0]


def test_only_what_orders_scores_is_kept_between(spark):
    from amplispark.catalog import placed_scores

    rows = placed_scores(scoring.scored(sites(spark)))
    assert rows.columns == ["record", "start", "end", "length", "type", "score"]
    assert [r.score for r in scoring.numbered_by_score(rows).orderBy("rank").collect()] == sorted((r.score for r in rows.collect() if r.score is not None), reverse=True) + [None] * rows.where("score is null").count()


def test_blocks_of_equal_amplicons_are_drawn_once(spark):
    from amplispark.sources import pretty

    pretty._remembered.cache_clear()
    row = {"fwd": "ACG", "rev": "CCC", "fwd_site": "ACG", "rev_site": "CCC", "length": 12, "fwd_mm_i": "", "rev_mm_i": "1"}
    each = [pretty._remembered(tuple(row[x] for x in pretty.COLUMNS), False, 95) for _ in range(3)]
    assert each == [pretty.block(row)] * 3 and pretty._remembered.cache_info().misses == 1
