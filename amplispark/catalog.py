"""Queries over the driver's tables, and the SQL that gives the same rows.

DNA is derived from the texts of documents and benchmark items by an expression
that both engines evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alphabet as al
from .functions import duplex, thermo
from .functions.structure import structure_of
from .operators import annotate, panel, scoring
from .operators.hits import hits, seed_hits
from .operators.products import amplicons, coordinate_order, deduplicated, numbered, ranked, with_sequences
from .session import ship, spread, table
from .sources import fasta, sinks

PAIR = panel.pair("p1", "TAGCTAGC", "CTAGCARY", 0, 0)
SHORT = panel.pair("p2", "ACTAGC", "GCNAGT", 0, 0)
THERMO = panel.pair("p3", "ACTAGC", "GCTAGT", 0, 0)
PROFILES = {k: duplex.Profile(k, knee=60) for k in ("binding", "pcr", "gel")}
POOLS = (["ACTAGC", "TTACTA"], ["GCNAGT", "CACTAG"])
MM, WINDOW, MOST = 1, 3, 400


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, as DNA."""
    ship(spark)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("record"), al.dna(F.col("text")).alias("seq"))


def csv(idx: str) -> Column:
    return F.array_join(F.col(idx).cast("array<string>"), ",")


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("record", "experiment_id", "start", "end", "length", "type", "fwd_mm", "rev_mm", "fwd_mm_i", "rev_mm_i")


def f_derive_dna(spark, sf_dir):
    rows = records(spark, sf_dir)
    return rows.select("record", F.length("seq").cast("long").alias("len"), F.length(F.regexp_replace("seq", "[^N]", "")).cast("long").alias("n_count"), F.md5("seq").alias("digest"))


def f_revcomp(spark, sf_dir, source=records):
    return source(spark, sf_dir).select("record", al.revcomp(F.col("seq")).alias("rc"), F.round(al.gc_fraction(F.col("seq")), 6).alias("gc"))


def f_iupac_expand(spark, sf_dir):
    rows = spark.createDataFrame([("ACRN",), ("BD",), ("ACGT",), ("NNNN",)], "primer string")
    return rows.select("primer", F.posexplode(al.expanded(F.col("primer"), 16)).alias("ord", "variant"))


def p_mismatch_hits(spark, sf_dir, source=records):
    return hits(source(spark, sf_dir), [SHORT], 1, 0).select("record", "orient", "pos", "mm", csv("mm_idx").alias("mm_i"))


def p_exact_hits(spark, sf_dir, source=records):
    return hits(source(spark, sf_dir), [SHORT]).select("record", "orient", "pos")


def p_terminal_window(spark, sf_dir, source=records):
    return hits(source(spark, sf_dir), [SHORT], 1, 2).select("record", "orient", "pos", "mm", csv("mm_idx").alias("mm_i"))


def p_seed_join_hits(spark, sf_dir, source=records):
    return seed_hits(source(spark, sf_dir), [SHORT], 1, 2).select("record", "orient", "pos", "mm", csv("mm_idx").alias("mm_i"))


def w_hit_cap(spark, sf_dir, source=records):
    return hits(source(spark, sf_dir), [SHORT], 1, 0, cap=3).select("record", "orient", "pos", "mm")


def _products(rows: DataFrame, pairs, circular=False, low=0, most=MOST, mm=MM, window=WINDOW, kinds="forward revcomp", sequences=False) -> DataFrame:
    return amplicons(rows, pairs, mm, window, low, most, circular, kinds=kinds, sequences=sequences)


def j_forward(spark, sf_dir):
    return shown(_products(records(spark, sf_dir), [PAIR], kinds="forward"))


def j_revcomp(spark, sf_dir):
    return shown(_products(records(spark, sf_dir), [PAIR], kinds="revcomp"))


def j_length_bounds(spark, sf_dir, source=records):
    return shown(_products(source(spark, sf_dir), [SHORT], low=30, most=90, window=2))


def j_circular(spark, sf_dir, source=records):
    rows = _products(source(spark, sf_dir), [SHORT], True, 0, 120, 1, 2)
    return rows.select("record", "experiment_id", "start", "end", "length", "type", "fwd_mm", "rev_mm", "is_wrap")


def j_self_pairs(spark, sf_dir, source=records):
    return shown(_products(source(spark, sf_dir), panel.with_self_pairs([SHORT]), most=90, window=2))


def j_multiplex_panel(spark, sf_dir, source=records):
    pairs = panel.from_pools(*POOLS) + panel.self_across_pools(*POOLS)
    return shown(_products(source(spark, sf_dir), pairs, most=90, mm=0, window=0))


def j_oligo_pairs(spark, sf_dir):
    oligos = panel.parse_oligos(["x:ACTA", "GCNA", "y CAC"])
    return panel.panel_table(spark, panel.oligo_pairs(oligos, True)).select("pair_id", "fwd", "rev")


def o_coord_rank(spark, sf_dir, source=records):
    return ranked(_products(source(spark, sf_dir), [SHORT], most=90, mm=0, window=0)).select("record", "start", "end", "type", F.col("rank").cast("long").alias("rank"))


def p_product_seq(spark, sf_dir, source=records):
    return _amplicons(spark, sf_dir, source).select("record", "start", "end", "type", F.md5("seq").alias("digest"))


def g_products_per_pair(spark, sf_dir):
    return _products(records(spark, sf_dir), [PAIR]).groupBy("experiment_id").agg(F.count("*").alias("n"))


def _amplicons(spark, sf_dir, source=records):
    return _products(source(spark, sf_dir), [SHORT], most=90, mm=0, window=0, sequences=True)


def v_probe(spark, sf_dir, source=records):
    got = annotate.with_probe(_amplicons(spark, sf_dir, source), "probe", "ACTAC", 1)
    return got.select("record", "start", "end", "type", "probe_found", "probe_strand", "probe_pos", "probe_mm", "probe_site")


def v_probe_require(spark, sf_dir, source=records):
    got = annotate.with_probe(_amplicons(spark, sf_dir, source), "probe", "ACTAC", 0, True)
    return got.select("record", "start", "end", "type", "probe_strand", "probe_pos")


def v_nested(spark, sf_dir, source=records):
    got = annotate.with_nested(_amplicons(spark, sf_dir, source), [panel.pair("inner", "TAG", "CAC")])
    return got.select("record", "start", "end", "type", "inner_found", "inner_start", "inner_end", "inner_length", "inner_type")


def tiles(spark, sf_dir):
    """Whole documents without their N as consecutive primers of 20 bases, the last one shorter, with their places."""
    each = F.posexplode(F.regexp_extract_all(F.regexp_replace("seq", "N", ""), F.lit(".{1,20}"), F.lit(0))).alias("k", "primer")
    return records(spark, sf_dir).select("record", each).select("record", (F.col("k") * 20).cast("long").alias("at"), "primer")


def t_tm_perfect(spark, sf_dir):
    """A last tile of one base has no stack, so its values are null."""
    p = F.col("primer")
    stacked = lambda x: F.when(F.length(p) > 1, F.round(x, 6))
    return tiles(spark, sf_dir).select("record", "at", "primer", stacked(thermo.tm(p)).alias("tm"), stacked(thermo.delta_g(p)).alias("dg"))


def t_salt_models(spark, sf_dir):
    tm = lambda m: F.struct(F.lit(m).alias("model"), F.when(F.length("primer") > 1, F.round(thermo.tm(F.col("primer"), thermo.Conditions(model=m, dntp=0.0008)), 6)).alias("tm"))
    return tiles(spark, sf_dir).select("record", "at", F.inline(F.array(*map(tm, ("monovalent", "owczarzy-lite", "owczarzy08")))))


def s_chunks(spark, sf_dir):
    rows = fasta.chunks(records(spark, sf_dir), 1000, 50)
    return rows.select("record", F.col("at").cast("long").alias("at"), F.md5("seq").alias("digest"))


def f_selfcomp(spark, sf_dir):
    """Which tiles are their own reverse complement, those of every other record with theirs."""
    p = F.col("primer")
    rows = tiles(spark, sf_dir).select("record", "at", F.concat(p, F.when(F.length("record") % 2 == 0, al.revcomp(p)).otherwise("")).alias("seq"))
    return rows.select("record", "at", "seq", thermo.self_complementary(F.col("seq")).alias("self_complementary"))


def p_reference_n_hits(spark, sf_dir, source=records):
    """Sites that hold an N of the record, each a mismatch."""
    rows = source(spark, sf_dir)
    n = F.when(F.col("orient").isin("A", "a"), len(SHORT.forward)).otherwise(len(SHORT.reverse)).cast("long")
    got = hits(rows, [SHORT], 1, 0).select("record", "pair_ord", F.col("pos").alias("start"), (F.col("pos") + n).alias("end"), n.alias("length"), F.col("orient").alias("type"), F.lit(False).alias("is_wrap"), "mm")
    got = with_sequences(got, rows).where("instr(seq, 'N') > 0")
    return got.select("record", F.col("type").alias("orient"), F.col("start").alias("pos"), "mm", F.col("seq").alias("site"))


def d_dedupe_overlap(spark, sf_dir, source=records):
    """Amplicons of overlapping chunks, each once, in the records' coordinates."""
    pieces = fasta.chunks(source(spark, sf_dir), 200, 60)
    named = pieces.select(fasta.chunk_id(F.col("record"), F.col("at"), F.col("seq")).alias("record"), "seq")
    base, at = fasta.split_chunk_id(F.col("record"))
    found = _products(named, [SHORT], most=60, mm=0, window=0)
    moved = found.select(base.alias("record"), "pair_ord", "experiment_id", (F.col("start") + at).alias("start"), (F.col("end") + at).alias("end"), "length", "type", "is_wrap")
    return deduplicated(moved).select("record", "experiment_id", "start", "end", "length", "type")


def v_nested_require(spark, sf_dir, source=records):
    got = annotate.with_nested(_amplicons(spark, sf_dir, source), [panel.pair("inner", "TAG", "CAC")], require=True)
    return got.select("record", "start", "end", "type", "inner_start", "inner_end", "inner_length", "inner_type")


def _sites(spark, sf_dir, pairs, source=records):
    return scoring.with_primers(_products(source(spark, sf_dir), pairs, most=90, mm=1, window=0, sequences=True), pairs)


def _six(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


def t_imperfect(spark, sf_dir, source=records):
    got = scoring.scored(_sites(spark, sf_dir, [THERMO], source))
    ends = [F.struct(F.lit(e).alias("side"), *[F.round(f"{e}_{x}", 6).alias(x) for x in ("tm", "penalty", "dg", "dangling_dg")], F.col(f"{e}_mismatches").alias("mismatches"), F.col(f"{e}_policy").alias("policy")) for e in scoring.ENDS]
    return got.select("record", "start", "end", "type", F.inline(F.array(*ends)))


def t_profiles(spark, sf_dir, source=records):
    got = scoring.scored(_sites(spark, sf_dir, [THERMO], source))
    score = lambda k: F.struct(F.lit(k).alias("profile"), F.round(duplex.profiled(F.col("base_score"), F.col("base_score"), F.col("length").cast("double"), PROFILES[k]), 6).alias("score"))
    return got.select("record", "start", "end", "type", F.inline(F.array(*[score(k) for k in PROFILES])))


def t_iupac_policy(spark, sf_dir, source=records):
    got = scoring.policies(_sites(spark, sf_dir, [SHORT], source))
    each = [F.struct(F.lit(p).alias("policy"), F.col("scores.variants").alias("variants"), F.round(f"scores.{x}", 6).alias("score")) for p, x in (("worst", "worst.score"), ("best", "best.score"), ("mean", "mean"))]
    return got.select("record", "start", "end", "type", F.inline(F.array(*each)))


def placed_scores(rows: DataFrame) -> DataFrame:
    """What orders the amplicons of one pair by score: only that is sorted and kept between."""
    return rows.select("record", "start", "end", "length", "type", F.round("score", 6).alias("score"))


def t_rank_score(spark, sf_dir, source=records):
    got = placed_scores(scoring.scored(_sites(spark, sf_dir, [THERMO], source)))
    return scoring.ranked_by_score(got).select("record", "start", "end", "type", "score", F.col("rank").cast("long").alias("rank"))


def t_legacy(spark, sf_dir, source=records):
    return scoring.older_score(_sites(spark, sf_dir, [THERMO], source)).select("record", "start", "end", "type", *_six("score"))


def _tile_structures(spark, sf_dir, kind, last):
    """Structures of the tiles; nothing is shuffled, as nearly all tiles differ."""
    rows = tiles(spark, sf_dir).withColumn("s", structure_of(kind)(F.col("primer")))
    return rows.select("record", "at", "primer", *[F.round(f"s.{x}", 6).alias(x) for x in ("dg", "tm")], "s.stem", f"s.{last}")


def t_hairpin(spark, sf_dir):
    return _tile_structures(spark, sf_dir, "hairpin", "loop")


def t_dimer(spark, sf_dir):
    return _tile_structures(spark, sf_dir, "self-dimer", "both_anchored")


def t_panel_dimer(spark, sf_dir, source=records):
    """Scores with structures; the panel's other primers count against a pair."""
    rows = scoring.scored(_sites(spark, sf_dir, [THERMO], source))
    others = [THERMO, panel.pair("q", "ACTAGCTAGT", "GCTAGGCTAGC")]
    got = scoring.with_structures(rows, others)
    return got.select("record", "start", "end", "type", *_six("score", "structure_c", "panel_c", "panel_burden_c"), "panel_count", "panel_partner")


def _probe_scores(spark, sf_dir, mode, source=records):
    rows = scoring.scored(_sites(spark, sf_dir, [THERMO], source))
    got = scoring.with_probe_score(rows, "probe", "ACTAC", 1, mode, least_margin=-150.0)
    return got.select("record", "start", "end", "type", "probe_found", "probe_strand", *_six("probe_margin", "score"))


def t_probe_gate(spark, sf_dir, source=records):
    return _probe_scores(spark, sf_dir, "gate", source)


def t_probe_blend(spark, sf_dir, source=records):
    return _probe_scores(spark, sf_dir, "blend", source)


def _wire(spark, sf_dir, source=records):
    rows = _amplicons(spark, sf_dir, source)
    return rows.withColumns({"source_file": F.lit("items.fa"), "sequence_id": F.col("record")})


def k_tsv(spark, sf_dir, source=records):
    return sinks.tsv_lines(_wire(spark, sf_dir, source))


def k_jsonl(spark, sf_dir, source=records):
    return sinks.json_lines(_wire(spark, sf_dir, source))


def k_fasta(spark, sf_dir, source=records):
    """The number in a header counts the amplicons of the whole output."""
    rows = _wire(spark, sf_dir, source)
    return sinks.fasta_lines(numbered(rows, coordinate_order(rows)))


QUERIES = {f.__name__: f for f in (f_derive_dna, f_revcomp, f_iupac_expand, p_exact_hits, p_mismatch_hits, p_terminal_window, p_seed_join_hits, w_hit_cap, j_forward, j_revcomp, j_length_bounds, j_circular, j_self_pairs, j_multiplex_panel, j_oligo_pairs, o_coord_rank, p_product_seq, g_products_per_pair, v_probe, v_probe_require, v_nested, t_tm_perfect, t_salt_models, s_chunks, f_selfcomp, p_reference_n_hits, d_dedupe_overlap, v_nested_require, t_imperfect, t_profiles, t_iupac_policy, t_rank_score, t_legacy, t_hairpin, t_dimer, t_panel_dimer, t_probe_gate, t_probe_blend, k_tsv, k_jsonl, k_fasta)}


def _records_sql(name: str, key: str) -> str:
    return f"select cast({key} as varchar) as record, {al.dna_sql('text')} as seq from {name}"


#: Bases of the pieces in which SQL looks for sites: letters far from a string's beginning are slow to reach.
SQL_PIECE = 64


def _site_sql(seq: str, window: tuple[int, int], mm: int, source: str) -> str:
    """(record, len, pos, bad) of one pattern; the protected bases are compared first."""
    accepts = [al.BASES[c] for c in seq]
    test = lambda j: f"instr('{accepts[j]}', substr(seq, i + {j + 1}, 1)) > 0"
    first = " and ".join(test(j) for j in range(*window)) or "true"
    bad = ", ".join(f"case when {test(j)} then null else {j} end" for j in range(len(seq)))
    pieces = f"select record, length(seq) as len, a, substr(seq, a + 1, {SQL_PIECE + len(seq) - 1}) as seq from (select record, seq, unnest(range(0, length(seq), {SQL_PIECE})) as a from {source})"
    return (
        f"select record, len, a + i as pos, bad from (select record, len, a, i, list_filter([{bad}], lambda x: x is not null) as bad from "
        f"(select record, len, a, seq, unnest(range(0, length(seq) - {len(seq)} + 1)) as i from ({pieces}) where length(seq) >= {len(seq)}) where {first}) where len(bad) <= {mm}"
    )


def _hits_sql(p: panel.Pair, mm: int, window: int, source: str, only: str = "ABab") -> str:
    each = []
    for o, s in panel.orientations(p).items():
        w = min(window, len(s))
        each.append(f"select '{o}' as orient, * from ({_site_sql(s, (len(s) - w, len(s)) if o in 'AB' else (0, w), mm, source)})" if o in only else "")
    return " union all ".join(x for x in each if x)


def _products_sql(p: panel.Pair, source: str, mm: int, window: int, low: int, most: int, kinds=("forward", "revcomp"), wrap: bool = False, columns: str = "") -> str:
    out = []
    for kind, a, b, n in (("forward", "A", "b", len(p.reverse)), ("revcomp", "B", "a", len(p.forward))):
        if kind not in kinds:
            continue
        for w in (False, True) if wrap else (False,):
            length = f"(r.pos + {n} - l.pos{' + l.len' if w else ''})"
            out.append(
                f"select l.record, '{p.id}' as experiment_id, l.pos as start, r.pos + {n} as \"end\", {length} as length, '{kind}' as type, len(l.bad) as fwd_mm, len(r.bad) as rev_mm, "
                f"array_to_string(l.bad, ',') as fwd_mm_i, array_to_string(list_transform(r.bad, lambda x: {n - 1} - x), ',') as rev_mm_i, {str(w).lower()} as is_wrap "
                f"from h l join h r on l.record = r.record where l.orient = '{a}' and r.orient = '{b}' and r.pos {'<' if w else '>'} l.pos and {length} >= {low} and {length} <= {most}"
            )
    need = "".join(x for k, x in (("forward", "Ab"), ("revcomp", "Ba")) if k in kinds)
    cast = "record, experiment_id, cast(start as bigint) as start, cast(\"end\" as bigint) as \"end\", cast(length as bigint) as length, type, cast(fwd_mm as int) as fwd_mm, cast(rev_mm as int) as rev_mm"
    return f"with h as materialized ({_hits_sql(p, mm, window, source, need)}) select {cast}{columns} from ({' union all '.join(out)})"


DOCS = f"({_records_sql('documents', 'doc_id')})"
IDX = ", fwd_mm_i, rev_mm_i"


def _hit_columns(sql: str, more: str = "") -> str:
    return f"select record, orient, cast(pos as bigint) as pos{more} from ({sql})"


MM_COLUMNS = ", cast(len(bad) as int) as mm, array_to_string(bad, ',') as mm_i"
PLAIN = _products_sql(SHORT, DOCS, 0, 0, 0, 90)


def _tm_sql(c: thermo.Conditions) -> str:
    import math

    n, half = "length(primer)", lambda k: "(" + " + ".join([f"{thermo.INITIATION[k]}", "list_sum(list_transform(range(1, length(primer)), lambda i: case substr(primer, i, 2) " + " ".join(f"when '{d}' then {v[k]}" for d, v in thermo.STACKS.items()) + " end))", *(f"case when {e} in ('A', 'T') then {thermo.TERMINAL_AT[k]} else 0 end" for e in ("left(primer, 1)", "right(primer, 1)")), f"case when primer = reverse(translate(primer, 'ACGT', 'TGCA')) then {thermo.SYMMETRY[k]} else 0 end"]) + ")"
    conc = f"{thermo.GAS} * ln({c.primer} / case when primer = reverse(translate(primer, 'ACGT', 'TGCA')) then 1 else 4 end)"
    return f"{half(0)} * 1000 / ({half(1)} + {0.368 * math.log(c.sodium())!r} * ({n} - 1) + {conc}) - 273.15", half(0)


TM, DH = _tm_sql(thermo.Conditions())
PRIMERS = f"select record, cast(20 * (i - 1) as bigint) as \"at\", parts[i] as primer from (select record, parts, unnest(range(1, len(parts) + 1)) as i from (select record, regexp_extract_all(replace(seq, 'N', ''), '.{{1,20}}') as parts from {DOCS}))"

ORACLE_SQL = {
    "f_derive_dna": f"select record, cast(length(seq) as bigint) as len, cast(length(regexp_replace(seq, '[^N]', '', 'g')) as bigint) as n_count, md5(seq) as digest from {DOCS}",
    "f_revcomp": f"select record, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, round(case when length(seq) > 0 then cast(length(regexp_replace(seq, '[^GC]', '', 'g')) as double) / length(seq) else 0 end, 6) as gc from {DOCS}",
    "p_exact_hits": _hit_columns(_hits_sql(SHORT, 0, 0, DOCS)),
    "p_mismatch_hits": _hit_columns(_hits_sql(SHORT, 1, 0, DOCS), MM_COLUMNS),
    "p_terminal_window": _hit_columns(_hits_sql(SHORT, 1, 2, DOCS), MM_COLUMNS),
    "p_seed_join_hits": _hit_columns(_hits_sql(SHORT, 1, 2, DOCS), MM_COLUMNS),
    "w_hit_cap": f"select record, orient, cast(pos as bigint) as pos, cast(len(bad) as int) as mm from (select *, row_number() over (partition by record, orient order by pos) as k from ({_hits_sql(SHORT, 1, 0, DOCS)})) where k <= 3",
    "j_length_bounds": _products_sql(SHORT, DOCS, 1, 2, 30, 90, columns=IDX),
    "j_circular": _products_sql(SHORT, DOCS, 1, 2, 0, 120, wrap=True, columns=", is_wrap"),
    "j_self_pairs": " union all ".join(f"select * from ({_products_sql(p, DOCS, 1, 2, 0, 90, columns=IDX)})" for p in panel.with_self_pairs([SHORT])),
    "j_multiplex_panel": " union all ".join(f"select * from ({_products_sql(p, DOCS, 0, 0, 0, 90, columns=IDX)})" for p in panel.from_pools(*POOLS) + panel.self_across_pools(*POOLS)),
    "j_oligo_pairs": "with o(ord, id, seq) as (values (1, 'x', 'ACTA'), (2, 'O2', 'GCNA'), (3, 'y', 'CAC')) select a.id || '+' || b.id as pair_id, a.seq as fwd, b.seq as rev from o a join o b on a.ord < b.ord union all select id || '+self', seq, seq from o",
    "o_coord_rank": f"select record, start, \"end\", type, row_number() over (partition by record order by start, \"end\", type) as rank from ({PLAIN})",
    "p_product_seq": f"select p.record, start, \"end\", type, md5(substr(seq, start + 1, length)) as digest from ({PLAIN}) p join {DOCS} r on p.record = r.record",
    "v_probe_require": f"select record, start, \"end\", type, case when instr(s, 'ACTAC') > 0 then '+' else '-' end as probe_strand, cast(case when instr(s, 'ACTAC') > 0 then instr(s, 'ACTAC') else instr(s, 'GTAGT') end - 1 as int) as probe_pos from (select p.*, substr(seq, start + 1, length) as s from ({PLAIN}) p join {DOCS} r on p.record = r.record) where instr(s, 'ACTAC') > 0 or instr(s, 'GTAGT') > 0",
    "t_tm_perfect": f"select record, \"at\", primer, round(tm, 6) as tm, round(dh - (60 + 273.15) * (dh * 1000 / (tm + 273.15)) / 1000, 6) as dg from (select record, \"at\", primer, {TM} as tm, {DH} as dh from ({PRIMERS}))",
    "s_chunks": f"select record, cast(a as bigint) as at, md5(substr(seq, a + 1, 1000)) as digest from (select record, seq, unnest(range(0, cast(greatest(0, ceil((length(seq) - 1000) / 950.0)) as bigint) * 950 + 1, 950)) as a from {DOCS})",
}


def _sites_sql(p: panel.Pair) -> str:
    """Amplicons with their primers and bases."""
    found = _products_sql(p, DOCS, 1, 0, 0, 90, columns=IDX)
    f, r = (f"case when type = 'forward' then '{x}' else '{y}' end" for x, y in ((p.forward, p.reverse), (p.reverse, p.forward)))
    return f"select p.*, {f} as fwd, {r} as rev, substr(seq, start + 1, length) as s from ({found}) p join {DOCS} r on p.record = r.record"


def _cost_sql(i: str = "i") -> str:
    """Cost in kcal/mol of the mismatch of primer and target at place i."""
    table = lambda t: "map {" + ", ".join(f"'{k}': {v}" for k, v in t.items()) + "}"
    a, b = f"substr('N' || primer || 'N', {i} + 1, 3)", f"substr('N' || target || 'N', {i} + 1, 3)"
    beside = f"({a}[1] || {a}[3] || {b}[1] || {b}[3])"
    count = lambda x: f"length(regexp_replace({beside}, '[^{x}]', '', 'g'))"
    return f"coalesce({table(duplex.triplets())}[{a} || {b}], {table(duplex.PAIR)}[{a}[2] || {b}[2]], case when {count('GC')} >= {count('AT')} + 2 then 0.95 else 1.0 end)"


WRONG = "list_filter(range(0, length(primer)), lambda i: translate(substr(primer, i + 1, 1), 'ACGT', 'TGCA') <> substr(target, i + 1, 1))"
WEIGHT = "case when i >= length(primer) - 3 then 2.0 when i < 3 then 1.5 else 1.0 end"
LAST = "case when i = length(primer) - 1 then 1.5 when i = 0 then 0.5 else 0.0 end"


def _ends_sql(sites: str, turned: bool = True) -> str:
    """Both ends of each amplicon: side, primer, target and the base beside the primer's 3' end."""
    rev = "reverse(right(s, length(rev)))" if turned else "translate(right(s, length(rev)), 'ACGT', 'TGCA')"
    key = "record, start, \"end\", length, type, fwd as f, rev as r"
    return (
        f"select {key}, 'fwd' as side, fwd as primer, translate(left(s, length(fwd)), 'ACGT', 'TGCA') as target, translate(substr(s, length(fwd) + 1, 1), 'ACGT', 'TGCA') as beside from ({sites}) "
        f"union all select {key}, 'rev', rev, {rev}, case when length(s) > length(rev) then substr(s, length(s) - length(rev), 1) else '' end from ({sites})"
    )


def _terms_sql(ends: str) -> str:
    """Penalty, dangling energy, tm and dg of each end."""
    dangle = "map {" + ", ".join(f"'{k}': {v}" for k, v in duplex.dangling(duplex.DANGLING_5).items()) + "}"
    inner = f"select *, {TM} as tm0, {DH} as dh, {WRONG} as bad from ({ends})"
    inner = f"select *, abs(dh * 1000 / (tm0 + 273.15)) as den from ({inner})"
    inner = (
        f"select *, coalesce(list_sum(list_transform(bad, lambda i: greatest(0.0, {_cost_sql()} * 1000 / den * {WEIGHT} + {LAST}))), 0) as penalty, "
        f"case when translate(right(primer, 1), 'ACGT', 'TGCA') = right(target, 1) then coalesce({dangle}[beside || right(target, 1)], 0) else 0 end as dangling_dg from ({inner})"
    )
    return f"select *, tm0 - penalty - dangling_dg * 1000 / den as tm, dh + (60 + 273.15) * den / 1000 + penalty * den / 1000 + dangling_dg as dg from ({inner})"


def _scores_sql(sites: str, more: str = "") -> str:
    """The smaller margin of each amplicon, and of each pair of plain primers."""
    return f"select record, start, \"end\", length, type{more}, cast(min(tm) - 60 as double) as base from ({_terms_sql(_ends_sql(sites))}) group by record, start, \"end\", length, type{more}"


def _policy_sql() -> str:
    spread = lambda c: f"unnest(case when instr({c}, 'N') > 0 then list_transform(['A', 'C', 'G', 'T'], lambda b: replace({c}, 'N', b)) else [{c}] end)"
    sites = f"select record, start, \"end\", length, type, s, {spread('fwd')} as fwd, rev from ({_sites_sql(SHORT)})"
    sites = f"select record, start, \"end\", length, type, s, fwd, {spread('rev')} as rev from ({sites})"
    each = _scores_sql(sites, ", f, r")
    return f"with e as materialized ({each}) " + " union all ".join(f"select record, start, \"end\", type, '{p}' as policy, cast(count(*) as bigint) as variants, round({f}(base), 6) as score from e group by record, start, \"end\", type" for p, f in (("worst", "min"), ("best", "max"), ("mean", "avg")))


def _profile_sql() -> str:
    x = "(1 / (1 + exp(-0.45 * base)))"
    pcr = f"base + (case when {x} <= 1e-9 then -20.0 when {x} >= 1 - 1e-9 then 20.0 else ln({x} / (1 - {x})) end) - (case when length <= 60 then 0.0 else 10.0 / (1 + exp(-0.003 * (length - 60))) end)"
    each = (("binding", "base"), ("pcr", pcr), ("gel", f"{pcr} + 15.0 * log2(length / 100.0)"))
    return f"with e as materialized ({_scores_sql(_sites_sql(THERMO))}) " + " union all ".join(f"select record, start, \"end\", type, '{k}' as profile, round({v}, 6) as score from e" for k, v in each)


def _nested_sql(join: str, more: str) -> str:
    inner = panel.pair("inner", "TAG", "CAC")
    outer = f"select p.*, substr(seq, start + 1, length) as s from ({PLAIN}) p join {DOCS} r on p.record = r.record"
    found = _products_sql(inner, f"(select distinct s as record, s as seq from ({outer}))", 0, 0, 0, 1 << 30)
    best = f"select *, row_number() over (partition by record order by fwd_mm + rev_mm, length desc, start, \"end\", type) as k from ({found})"
    return f"select o.record, o.start, o.\"end\", o.type{more}, i.start as inner_start, i.\"end\" as inner_end, i.length as inner_length, i.type as inner_type from ({outer}) o {join} join (select * from ({best}) where k = 1) i on o.s = i.record"


def _probe_sql() -> str:
    outer = f"select p.*, substr(seq, start + 1, length) as s from ({PLAIN}) p join {DOCS} r on p.record = r.record"
    source = f"(select distinct s as record, s as seq from ({outer}))"
    each = " union all ".join(f"select record, '{strand}' as strand, {k} as n, pos, len(bad) as mm from ({_site_sql(q, (0, 0), 1, source)})" for k, strand, q in ((0, "+", "ACTAC"), (1, "-", "GTAGT")))
    best = f"select *, row_number() over (partition by record order by mm, pos, n) as k from ({each})"
    return f"select o.record, start, \"end\", type, b.record is not null as probe_found, strand as probe_strand, cast(pos as int) as probe_pos, cast(mm as int) as probe_mm, case when b.record is not null then substr(s, cast(pos as int) + 1, 5) end as probe_site from ({outer}) o left join (select * from ({best}) where k = 1) b on o.s = b.record"


def _salts_sql() -> str:
    import math

    c = thermo.Conditions(model="owczarzy08", dntp=0.0008)
    gc = "(cast(length(regexp_replace(primer, '[^GC]', '', 'g')) as double) / length(primer))"
    at_0, at_1 = thermo.magnesium_shift(0.0, 0.0, c), thermo.magnesium_shift(1.0, 0.0, c)
    stack = thermo.magnesium_shift(0.0, 1.0, c) - at_0
    plain, dh = _tm_sql(c)
    bare = plain.replace(f"{0.368 * math.log(c.sodium())!r} * (length(primer) - 1)", "0")
    kelvin = f"(1 / (1 / ({bare} + 273.15) + {at_0!r} + {at_1 - at_0!r} * {gc} + {stack!r} * 0.5 / (length(primer) - 1)))"
    each = [(m, _tm_sql(thermo.Conditions(model=m, dntp=0.0008))[0]) for m in ("monovalent", "owczarzy-lite")] + [("owczarzy08", f"{kelvin} - 273.15")]
    return " union all ".join(f"select record, \"at\", '{m}' as model, round({x}, 6) as tm from ({PRIMERS})" for m, x in each)


def _legacy_sql() -> str:
    cost = f"greatest(0.0, coalesce(list_sum(list_transform({WRONG}, lambda i: {_cost_sql()} * 1000 / 200.0 * {WEIGHT})), 0))"
    return f"select record, start, \"end\", type, round(-sum({cost}), 6) as score from ({_ends_sql(_sites_sql(THERMO), False)}) group by record, start, \"end\", type"


def _lines_sql(value: str) -> str:
    return f"select {value} as value from (select p.*, substr(seq, start + 1, length) as s, row_number() over (order by p.record, start, \"end\", length, type) as n from ({_products_sql(SHORT, DOCS, 0, 0, 0, 90, columns=IDX)}) p join {DOCS} r on p.record = r.record)"


SELF = "primer || case when length(record) % 2 = 0 then reverse(translate(primer, 'ACGT', 'TGCA')) else '' end"
POLICY = "case when len(bad) = 0 then 'perfect' when instr(target, 'N') > 0 then 'unknown base' when len(list_filter(bad, lambda i: map {" + ", ".join(f"'{k}': 1" for k in duplex.triplets()) + "}[substr('N' || primer || 'N', i + 1, 3) || substr('N' || target || 'N', i + 1, 3)] is not null)) > 0 then 'triplet' else 'pair' end"

def _probe_score_sql(mode: str) -> str:
    """Scores moved by the margin of the probe, which is a primer on its site."""
    sites = _sites_sql(THERMO)
    source = f"(select distinct s as record, s as seq from ({sites}))"
    each = " union all ".join(f"select record, '{strand}' as strand, {k} as n, pos, len(bad) as mm from ({_site_sql(q, (0, 0), 1, source)})" for k, strand, q in ((0, "+", "ACTAC"), (1, "-", "GTAGT")))
    best = f"select *, row_number() over (partition by record order by mm, pos, n) as k from ({each})"
    hit = f"select record as s, strand, substr(record, cast(pos as int) + 1, 5) as site from ({best}) where k = 1"
    ends = f"select s, strand, 'ACTAC' as primer, case when strand = '-' then reverse(site) else translate(site, 'ACGT', 'TGCA') end as target, '' as beside from ({hit})"
    probe = f"select s, strand, tm - 60 as margin from ({_terms_sql(ends)})"
    base = f"select b.*, a.s from ({_scores_sql(sites)}) b join ({sites}) a using (record, start, \"end\", type)"
    score = {"gate": "base", "blend": "case when margin is null then base - 12 else least(base, margin) end"}[mode]
    where = "where margin >= -150" if mode == "gate" else ""
    return f"select record, start, \"end\", type, strand is not null as probe_found, strand as probe_strand, round(margin, 6) as probe_margin, round({score}, 6) as score from ({base}) left join ({probe}) using (s) {where}"


def _json_sql() -> str:
    """Fields in order, those that are empty or 0 left out."""
    text = lambda k, c: f"'\"{k}\":\"' || {c} || '\"'"
    number = lambda k, c: f"'\"{k}\":' || {c}"
    some = lambda x, c, none: f"case when {c} <> {none} then {x} end"
    fields = [text("experiment_id", "experiment_id"), text("sequence_id", "record"), number("start", "start"), number("end", '"end"'), number("length", "length"), text("type", "type")]
    fields += [some(number(k, k), k, 0) for k in ("fwd_mm", "rev_mm")]
    fields += [some(f"'\"{k}\":[' || {k} || ']'", k, "''") for k in ("fwd_mm_i", "rev_mm_i")]
    fields += [some(text("seq", "s"), "s", "''"), "'\"source_file\":\"items.fa\"'"]
    return "'{' || concat_ws(',', " + ", ".join(fields) + ") || '}'"


ORACLE_SQL |= {
    "j_forward": _products_sql(PAIR, DOCS, MM, WINDOW, 0, MOST, ("forward",), columns=IDX),
    "j_revcomp": _products_sql(PAIR, DOCS, MM, WINDOW, 0, MOST, ("revcomp",), columns=IDX),
    "g_products_per_pair": f"select experiment_id, count(*) as n from ({_products_sql(PAIR, DOCS, MM, WINDOW, 0, MOST)}) group by experiment_id",
    "t_probe_gate": _probe_score_sql("gate"),
    "t_probe_blend": _probe_score_sql("blend"),
    "k_jsonl": _lines_sql(_json_sql()),
    "f_iupac_expand": "select 'ACRN' as primer, cast(k as int) as ord, 'AC' || ['A', 'G'][k // 4 + 1] || ['A', 'C', 'G', 'T'][k % 4 + 1] as variant from (select unnest(range(8)) as k) union all select 'BD', cast(k as int), ['C', 'G', 'T'][k // 3 + 1] || ['A', 'G', 'T'][k % 3 + 1] from (select unnest(range(9)) as k) union all select 'ACGT', 0, 'ACGT' union all select 'NNNN', cast(k as int), 'AA' || ['A', 'C', 'G', 'T'][k // 4 + 1] || ['A', 'C', 'G', 'T'][k % 4 + 1] from (select unnest(range(16)) as k)",
    "f_selfcomp": f"select record, \"at\", seq, seq = reverse(translate(seq, 'ACGT', 'TGCA')) as self_complementary from (select record, \"at\", {SELF} as seq from ({PRIMERS}))",
    "p_reference_n_hits": f"select * from (select record, orient, cast(pos as bigint) as pos, cast(len(bad) as int) as mm, substr(seq, cast(pos as int) + 1, 6) as site from ({_hits_sql(SHORT, 1, 0, DOCS)}) h join {DOCS} i using (record)) where instr(site, 'N') > 0",
    "d_dedupe_overlap": f"select record, experiment_id, start, \"end\", length, type from ({_products_sql(SHORT, DOCS, 0, 0, 0, 60)})",
    "v_nested": _nested_sql("left", ", i.record is not null as inner_found"),
    "v_nested_require": _nested_sql("inner", ""),
    "v_probe": _probe_sql(),
    "t_salt_models": _salts_sql(),
    "t_imperfect": f"select record, start, \"end\", type, side, round(tm, 6) as tm, round(penalty, 6) as penalty, round(dg, 6) as dg, round(cast(dangling_dg as double), 6) as dangling_dg, cast(len(bad) as int) as mismatches, {POLICY} as policy from ({_terms_sql(_ends_sql(_sites_sql(THERMO)))})",
    "t_profiles": _profile_sql(),
    "t_iupac_policy": _policy_sql(),
    "t_rank_score": f"select record, start, \"end\", type, round(base, 6) as score, row_number() over (partition by record order by round(base, 6) desc, start, \"end\", type) as rank from ({_scores_sql(_sites_sql(THERMO))})",
    "t_legacy": _legacy_sql(),
    "k_tsv": _lines_sql("concat_ws(chr(9), 'items.fa', record, experiment_id, start, \"end\", length, type, fwd_mm, rev_mm, fwd_mm_i, rev_mm_i)"),
    "k_fasta": _lines_sql("'>' || experiment_id || '_' || n || ' start=' || start || ' end=' || \"end\" || ' len=' || length || ' source_file=items.fa' || chr(10) || s"),
}
