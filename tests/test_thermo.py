"""Imperfect duplexes, profiles, policies, structures and probe scores on hand-made cases with known values."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from amplispark.functions import duplex, structure, thermo
from amplispark.functions.thermo import Conditions
from amplispark.operators import panel, scoring
from amplispark.operators.hits import hits
from amplispark.operators.products import products, with_sequences


def terms(spark, primer, target, beside="", c=Conditions()):
    rows = spark.createDataFrame([(primer, target, beside)], "p string, t string, b string")
    return duplex.imperfect(rows, "p", "t", "x_", c, "b").first()


def test_triplet_costs_are_complete_and_known():
    table = duplex.triplets()
    assert len(table) == 192
    assert (table["AAATAT"], table["CCAGTT"], table["GTACCT"], table["GTACTT"]) == (3.30, 4.66, 3.97, 3.15)


def test_internal_mismatch(spark):
    got = terms(spark, "ACGTACGTACGTACGT", "TGCATGCCTGCATGCA")
    assert got.x_tm == pytest.approx(39.7251567119435, abs=1e-9)
    assert got.x_penalty == pytest.approx(10.1289600599072, abs=1e-9)
    assert (got.x_mismatches, got.x_policy) == (1, "triplet")


@pytest.mark.parametrize("primer,beside,dg", [("ACGTACGTACGTACGT", "G", -0.62), ("ACGTACGTACGTACGA", "G", 0.48)])
def test_dangling_base(spark, primer, beside, dg):
    target, c = primer.translate(str.maketrans("ACGT", "TGCA")), Conditions(anneal_c=37, na=1.0)
    got, bare = terms(spark, primer, target, beside, c), terms(spark, primer, target, "", c)
    assert got.x_dangling_dg == pytest.approx(dg)
    assert (got.x_tm > bare.x_tm) == (dg < 0)


@pytest.mark.parametrize("primer, five, three, dg", [("ACGTACGTACGTACGT", "C", "", -0.19), ("TCGTACGTACGTACGT", "C", "", 0.28), ("ACGTACGTACGTACGT", "C", "G", -0.81), ("ACGTACGTACGTACGT", "", "G", -0.62)])
def test_dangling_bases_at_both_ends(spark, primer, five, three, dg):
    rows = spark.createDataFrame([(primer, primer.translate(str.maketrans("ACGT", "TGCA")), three, five)], "p string, t string, three string, five string")
    got = duplex.imperfect(rows, "p", "t", "x_", Conditions(anneal_c=37, na=1.0), "three", "five").first()
    assert got.x_dangling_dg == pytest.approx(dg, abs=1e-12)


def test_last_base_unknown_target_and_unusable_rows(spark):
    got = terms(spark, "ACGTACGTACGTACGA", "TGCATGCATGCATGCN")
    assert got.x_penalty == pytest.approx(0.95 * 1000 / got.x_denominator * 2 + 1.5) or got.x_penalty == pytest.approx(1.0 * 1000 / got.x_denominator * 2 + 1.5)
    assert got.x_policy == "unknown base"
    for p, t in (("ACGN", "TGCA"), ("ACG", "TGCA"), ("", ""), (None, "A"), ("A", None)):
        assert terms(spark, p, t).x_tm is None


@pytest.mark.parametrize("model,mg,dntp,tm", [("monovalent", 0.0, 0.0, 54.9327554351536), ("owczarzy-lite", 0.003, 0.0, 63.3566376107916), ("owczarzy08", 0.003, 0.0, 62.3632523878526), ("owczarzy08", 0.003, 0.0008, 61.8726505016164)])
def test_salts(spark, model, mg, dntp, tm):
    c = Conditions(mg=mg, dntp=dntp, model=model)
    got = spark.createDataFrame([("GGAAAGACATATCCCAATACAGCAA",)], "p string").select(thermo.tm(F.col("p"), c)).first()[0]
    assert got == pytest.approx(tm, abs=1e-9)


def test_structures_with_known_values():
    h = structure.structure("hairpin", "gapped", "GCGCGTTTTCGCGC")
    assert (h.tm, h.dg, h.stem, h.loop) == (pytest.approx(56.2369388901), pytest.approx(0.426391392832), 5, 4)
    d = structure.structure("cross-dimer", "gapped", "AAAACGCGCGCGCGCG", "TTTTCGCGCGCGCGCG")
    assert (d.tm, d.dg, d.stem) == (pytest.approx(59.9950301859), pytest.approx(0.00167676854828), 12)
    assert structure.structure("hairpin", "ensemble", "AAAAAAAAAAAAAAAA") is None
    for bad in (None, "", "ACGN"):
        assert structure.structure("self-dimer", "ensemble", bad) is None
    with pytest.raises(ValueError):
        structure.structure("knot", "stem", "ACGT")


def test_folding_equals_enumeration():
    """All nested pairings of short strands, one by one."""
    rng, c = random.Random(3), Conditions()
    rt = thermo.GAS / 1000 * (c.anneal_c + 273.15)

    def pairings(i, j):
        if j - i < 2:
            return [()]
        out = list(pairings(i, j - 1))
        for k in range(i, j - 1 - structure.LOOP):
            if structure.PARTNER[seq[k]] == seq[j - 1]:
                out += [(*a, *b, seq[k]) for a in pairings(i, k) for b in pairings(k + 1, j - 1)]
        return out

    for _ in range(10):
        seq = "".join(rng.choice("ACGT") for _ in range(11))
        found = pairings(0, len(seq))
        w = [math.exp(-sum(structure.FOLD_PAIR[b] for b in x) / rt) for x in found]
        z, pairs, dg = structure.folding(seq, c)
        assert z == pytest.approx(sum(w))
        assert pairs == pytest.approx(sum(a * len(x) for a, x in zip(w, found, strict=True)) / sum(w))
        assert dg == pytest.approx(-rt * math.log(sum(w)))


def amplicons(spark, seq, pairs, mm=0):
    rows = spark.createDataFrame([("s", seq)], "record string, seq string")
    return scoring.with_primers(with_sequences(products(hits(rows, pairs, mm, 0), pairs), rows), pairs)


SEQ = "TTACGTAGGATCCATTTTGACGTCCAAGTTGGCATGCATT"


def test_policies_choose_among_variants(spark):
    degenerate = [panel.pair("p", "ACGTNGGATCC", "GCATGCCRACTT")]
    rows = amplicons(spark, SEQ, degenerate)
    one = {}
    for f, r in itertools.product("ACGT", "AG"):
        p = [panel.pair("p", f"ACGT{f}GGATCC", f"GCATGCC{r}ACTT")]
        got = scoring.scored(rows.drop("fwd", "rev").withColumns({"fwd": F.lit(p[0].forward), "rev": F.lit(p[0].reverse)})).first()
        one[got.fwd, got.rev] = got.score
    for policy, pick in (("worst", min), ("best", max)):
        got = scoring.by_policy(rows, policy).first()
        assert (got.score, got.variants) == (pytest.approx(pick(one.values())), 8)
        assert one[got.fwd, got.rev] == pytest.approx(got.score)
    assert scoring.by_policy(rows, "mean").first().score == pytest.approx(sum(one.values()) / 8)
    everything = scoring.by_policy(rows, "enumerate").first()
    assert [(x.fwd, x.rev) for x in everything["all"]] == list(one)
    assert scoring.by_policy(rows, "strict").first().score is None
    assert scoring.by_policy(rows, "worst", most=3).first().variants == 3


def test_profiles(spark):
    rows = scoring.scored(amplicons(spark, SEQ, [panel.pair("p", "ACGTAGGATCC", "GCATGCCAACTT")]))
    base = rows.first().base_score
    length = rows.first().length
    for kind in ("binding", "pcr", "gel"):
        p = duplex.Profile(kind, knee=10)
        got = rows.select(duplex.profiled(F.col("base_score"), F.col("base_score"), F.col("length").cast("double"), p)).first()[0]
        logit = max(-20.0, 0.45 * base)
        want = base if kind == "binding" else base + logit - 10 / (1 + math.exp(-0.003 * (length - 10)))
        assert got == pytest.approx(want + (15 * math.log2(length / 100) if kind == "gel" else 0))
    with pytest.raises(ValueError):
        duplex.Profile("other")


def test_ranks_put_nan_and_null_last(spark):
    rows = [("r", i, i + 5, "forward", "e", 0, 0, "", "", s) for i, s in enumerate((1.0, float("nan"), None, 3.0, 1.0))]
    df = spark.createDataFrame(rows, "record string, start long, end long, type string, experiment_id string, fwd_mm int, rev_mm int, fwd_mm_i string, rev_mm_i string, score double")
    assert [r.start for r in scoring.ranked_by_score(df).orderBy("rank").collect()] == [3, 0, 4, 1, 2]


def test_structures_lower_the_score(spark):
    p = [panel.pair("p", "ACGTAGGATCC", "GCATGCCAACTT")]
    rows = scoring.scored(amplicons(spark, SEQ, p))
    other = panel.pair("q", "GGATCCTACGT", "AAGTTGGCATGC")  # complements of both primers
    got = scoring.with_structures(rows, [*p, other]).first()
    assert got.panel_count >= 2 and got.panel_c > 0 and got.panel_burden_c >= got.panel_c
    assert got.score == pytest.approx(got.base_score - got.hairpin_c - got.self_dimer_c - got.cross_dimer_c - got.panel_c)
    free = scoring.with_structures(rows, [*p, other], scale=0.0).first()
    assert free.score == pytest.approx(free.base_score)
    alone = scoring.with_structures(rows, p).first()
    assert (alone.panel_count, alone.panel_c, alone.panel_partner) == (0, 0.0, None)


def test_probe_modes(spark):
    p = [panel.pair("p", "ACGTAGGATCC", "GCATGCCAACTT")]
    rows = scoring.scored(amplicons(spark, SEQ, p))
    score = rows.first().score
    plus = scoring.with_probe_score(rows, "x", "TTTTGACGTCC", mode="annotate").first()
    minus = scoring.with_probe_score(rows, "x", "GGACGTCAAAA", mode="annotate").first()
    assert (plus.probe_strand, minus.probe_strand) == ("+", "-")
    assert plus.probe_tm == pytest.approx(minus.probe_tm) and plus.score == pytest.approx(score)
    assert scoring.with_probe_score(rows, "x", "TTTTGACGTCC", mode="gate", least_margin=99.0).count() == 0
    assert scoring.with_probe_score(rows, "x", "TTTTGACGTCC", mode="gate", least_margin=-99.0).count() == 1
    assert scoring.with_probe_score(rows, "x", "GGGGGGGG", mode="gate", least_margin=-99.0).count() == 0
    assert scoring.with_probe_score(rows, "x", "GGGGGGGG", mode="blend").first().score == pytest.approx(score - 12)
    blend = scoring.with_probe_score(rows, "x", "TTTTGACGTCC", mode="blend", weight=0.25).first()
    assert blend.score == pytest.approx(0.75 * score + 0.25 * min(score, blend.probe_margin))
    worst, best, mean = (scoring.with_probe_score(rows, "x", "TTTTNACGTCC", mode="annotate", policy=q).first().probe_margin for q in ("worst", "best", "mean"))
    assert worst < mean < best
    with pytest.raises(ValueError):
        scoring.with_probe_score(rows, "x", "TTTTN", policy="strict")


def test_older_score_keeps_its_peculiarity(spark):
    palindrome = amplicons(spark, "TTACGTAGGATCCATTTTGACGTTTGGTACCTT", [panel.pair("p", "ACGTAGG", "GGTACC")])
    assert scoring.older_score(palindrome).select("score").first()[0] == pytest.approx(0.0)
    other = amplicons(spark, SEQ, [panel.pair("p", "ACGTAGGATCC", "GCATGCCAACTT")])
    assert scoring.older_score(other).select("score").first()[0] < 0


def cost_at(p, t, i, j):
    """Cost of the pair of p[i] and t[j] among its neighbours in degrees, at the place's weight."""
    at = lambda s, k: s[k] if 0 <= k < len(s) else "N"
    if duplex.PARTNER[p[i]] == t[j]:
        return 0.0
    key = at(p, i - 1) + p[i] + at(p, i + 1) + at(t, j - 1) + t[j] + at(t, j + 1)
    cost = duplex.triplets().get(key, duplex.PAIR.get(p[i] + t[j], 1.0))
    return cost * 1000 / 200 * weight_at(i, len(p))


def weight_at(i, n):
    return 2.0 if i >= n - 3 else 1.5 if i < 3 else 1.0


def one_gap(p, t, gaps=True):
    """Every alignment with one gap, by its definition."""
    n, m = len(p), len(t)
    if n == m:
        return sum(cost_at(p, t, i, i) for i in range(n))
    if abs(n - m) != 1:
        return 0.0
    long = m > n
    places = range(n + 1 if long else n) if gaps else [n if long else n - 1]
    each = []
    for k in places:
        total = sum(cost_at(p, t, i, i) for i in range(k)) + 6.0 * weight_at(k, n)
        each.append(total + (sum(cost_at(p, t, i, i + 1) for i in range(k, n)) if long else sum(cost_at(p, t, i, i - 1) for i in range(k + 1, n))))
    return min(each)


@pytest.mark.parametrize("gaps", [True, False])
def test_gapped_penalty_equals_all_alignments(spark, gaps):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = []
    for n in (1, 2, 5, 12):
        for d in (-2, -1, 0, 1, 2):
            for _ in range(4):
                p = word(n)
                t = list(p.translate(str.maketrans("ACGT", "TGCA")))
                if d == 1:
                    t.insert(rng.randrange(n + 1), rng.choice("ACGT"))
                rows.append((p, "".join(t) if d in (0, 1) else word(max(0, n + d))))
    df = spark.createDataFrame(rows, "p string, t string").select("p", "t", scoring.gapped_penalty(F.col("p"), F.col("t"), 200.0, gaps).alias("got"))
    for r in df.collect():
        assert r.got == pytest.approx(one_gap(r.p, r.t, gaps), abs=1e-9), r


def test_older_score_known_values(spark):
    rows = amplicons(spark, "ACGTACAAAAAAGGTACC", [panel.pair("p", "AAGTAC", "GGTACC")], 1)
    assert min(r.score for r in scoring.older_score(rows).collect()) == pytest.approx(-29.625)
    auto = scoring.older_score(rows, "auto").orderBy("start", "end").collect()
    own = rows.select("start", "end", scoring.auto_denominator(F.col("fwd")).alias("f"), scoring.auto_denominator(F.col("rev")).alias("r")).orderBy("start", "end").collect()
    assert len(auto) == len(own) and all(100 < x.f < 250 and 100 < x.r < 250 for x in own)
    plain = {(r.start, r.end): r.score for r in scoring.older_score(rows).collect()}
    single = {(r.start, r.end): r.score for r in scoring.older_score(rows, single_strand=True).collect()}
    assert plain.keys() == single.keys() and all(single[k] <= 0 for k in single)
    assert spark.range(1).select(scoring.auto_denominator(F.lit("ACGN"))).first()[0] == 200.0


def test_pair_costs_hold_whatever_the_neighbours(spark):
    """A mismatch at an end has no triplet, so its family's cost holds, weighted and with what the very end adds."""
    for primer, target, cost in (("GGGGGGGGGG", "ACCCCCCCCC", 0.85), ("GAAAAAAAAA", "TTTTTTTTTT", 0.60), ("CCCCCCCCCC", "CGGGGGGGGG", 1.40)):
        got = terms(spark, primer, target)
        assert got.x_penalty == pytest.approx(cost * 1000 / got.x_denominator * 1.5 + 0.5) and got.x_policy == "pair"


def test_mismatches_weigh_more_at_the_3_prime_end(spark):
    perfect = "CCCCCCCCCC"
    at = lambda i: terms(spark, "GGGGGGGGGG", perfect[:i] + "A" + perfect[i + 1 :]).x_penalty
    assert at(9) > at(0) > 0 and at(4) > 0


def test_no_denominator(spark):
    assert spark.range(1).select(F.array(duplex.in_degrees(F.lit(1.0), 0.0), duplex.in_degrees(F.lit(1.0), 200.0))).first()[0] == [4.0, 5.0]


def test_concentrations_and_conditions():
    assert [thermo.concentration(x) for x in ("50mM", "250 nM", "3uM", "3µM", "3 μM", "0.05", "1e-3M")] == pytest.approx([0.05, 2.5e-7, 3e-6, 3e-6, 3e-6, 0.05, 1e-3])
    for bad in ("-3mM", "x", "3kM", "", "3 m M"):
        with pytest.raises(ValueError):
            thermo.concentration(bad)
    assert Conditions(anneal_c=0, na=0, mg=0, primer=0).with_defaults() == Conditions(mg=0)
    assert thermo.salt_model(" OWCZARZY08 ") == "owczarzy08" and thermo.salt_model("") == "monovalent"
    with pytest.raises(ValueError):
        Conditions(model="none")
    with pytest.raises(ValueError):
        thermo.salt_model("none")


def test_details_of_a_known_duplex(spark):
    from amplispark.operators import details
    from amplispark.sources import sinks

    rows = amplicons(spark, SEQ, [panel.pair("p", "ACGTAGGATCC", "GCATGCCAACTT")], 1)
    got = details.with_details(scoring.scored(rows))
    r = got.where("fwd_mm = 0 and rev_mm = 0").first().asDict()
    assert len(details.COLUMNS) == len(set(details.COLUMNS)) == 113 and set(details.COLUMNS) <= set(got.columns)
    assert (r["thermo_model"], r["fwd_mismatch_policy"], r["fwd_mismatch_count"], r["fwd_mismatch_sources"], r["structure_penalty_c"]) == ("nn-duplex-v1", "nn-perfect", 0, "", 0.0)
    line = details.detail_lines(got.where("fwd_mm = 0 and rev_mm = 0")).first()[0].split("\t")
    assert len(line) == 113 and line[0] == "nn-duplex-v1" and line[details.COLUMNS.index("fwd_mismatch_count")] == "" and line[details.COLUMNS.index("probe_found")] == ""
    thermo_object = json.loads(sinks.json_lines(got.withColumns({"thermo": details.thermo_struct(got), "sequence_id": F.lit("s"), "experiment_id": F.lit("p")})).first()[0])["thermo"]
    assert thermo_object["model"] == "nn-duplex-v1" and "mismatch_count" not in thermo_object["fwd"] and thermo_object["fwd"]["side"] == "fwd"
    whole = scoring.with_probe_score(scoring.with_structures(scoring.scored(rows)), "x", "CATTNTG", 1, "annotate")
    all_of_it = details.with_details(whole, probe_mode="annotate").first().asDict()
    assert all_of_it["thermo_model"] == "nn-structure-v1" and all_of_it["probe_iupac_expansion_count"] == 4 and all_of_it["hairpin_penalty_c"] is not None
    assert len(details.detail_lines(details.with_details(whole)).first()[0].split("\t")) == 113


def test_details_of_a_mismatch(spark):
    from amplispark.operators import details

    df = spark.createDataFrame([("ACGTACGTACGTACGT", "TGCATGCCTGCATGCA"), ("GGGGGGGGGG", "CCCCCCCCCA")], "p string, t string")
    got = duplex.imperfect(df, "p", "t", "x_")
    terms_of = details.end_terms(F.col("p"), F.col("t"), F.col("x_denominator"), F.col("x_penalty"), F.col("x_dangling_dg"), F.lit(False))
    a, b = got.select(*[c.alias(k.replace("3p", "three").replace("5p", "five")) for k, c in terms_of.items()]).collect()
    assert (a.mismatch_count, a.five_mismatch_count, a.three_mismatch_count, a.mismatch_triplet_count, a.mismatch_curated_pair_count, a.mismatch_fallback_count) == (1, 0, 0, 1, 0, 0)
    assert a.mismatch_dg_kcal == pytest.approx(3.97, abs=1e-9) and a.mismatch_sources == "triplet-ddg" and a.end_effect_policy == "none"
    assert (b.mismatch_curated_pair_count, b.three_terminal_mismatch_penalty_c, b.five_terminal_mismatch_penalty_c, b.end_effect_policy) == (1, 1.5, 0.0, "nn-terminal-mismatch-v1")


def test_overrides_count_by_how_much_they_know(spark):
    primer, target = "ACGTACGTACGTACGT", "TGCATGCCTGCATGCA"  # GTA over CCT at place 7
    plain = terms(spark, primer, target)
    rows = spark.createDataFrame([(primer, target)], "p string, t string")
    cost = lambda **x: duplex.imperfect(rows, "p", "t", "x_", overrides=duplex.Overrides(**x)).first()
    key = primer[6:9] + target[6:9]
    loose = f"N{key[1]}NN{key[4]}N"
    assert cost(kcal={loose: 1.0}).x_penalty == pytest.approx(1.0 * 1000 / plain.x_denominator)
    assert cost(kcal={loose: 1.0, f"{key[:3]}N{key[4]}N": 2.0}).x_penalty == pytest.approx(2.0 * 1000 / plain.x_denominator)
    assert cost(kcal={key: 3.0, loose: 1.0, f"N{key[1]}N{key[3:]}": 2.0}).x_penalty == pytest.approx(3.0 * 1000 / plain.x_denominator)
    assert cost(kcal={key: 3.0}, degrees={loose: 4.5}).x_penalty == pytest.approx(4.5)
    assert cost(kcal={"AAAAAA": 9.0}).x_penalty == plain.x_penalty
