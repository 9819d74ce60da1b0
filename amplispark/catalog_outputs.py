"""More queries over the driver's tables, with their SQL: sources, panels, orders, details, older scores and formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import (
    DH,
    DOCS,
    IDX,
    PLAIN,
    POLICY,
    PRIMERS,
    SHORT,
    THERMO,
    TM,
    WEIGHT,
    WRONG,
    _cost_sql,
    _ends_sql,
    _nested_sql,
    _probe_sql,
    _products,
    _products_sql,
    _scores_sql,
    _sites,
    _sites_sql,
    _six,
    _terms_sql,
    _wire,
    placed_scores,
    records,
    tiles,
)
from .functions import alphabet as al
from .functions import duplex, thermo
from .operators import annotate, details, panel, scoring
from .operators.products import coordinate_order, numbered
from .session import shared_folder
from .sources import fasta, pretty, sinks


def p_sites(spark, sf_dir):
    """The bases that each primer of an amplicon binds, read in the primer's direction."""
    got = scoring.with_sites(_sites(spark, sf_dir, [SHORT]))
    return got.select("record", "start", "end", "type", "fwd_site", "rev_site")


def p_iupac_match(spark, sf_dir):
    """All pairs of letters, of which U is outside the alphabet."""
    rows = spark.createDataFrame([(p, g) for p in al.LETTERS + "U" for g in al.LETTERS + "U"], "p string, g string")
    return rows.select("p", "g", al.matches_letters(F.lower("p"), F.col("g")).alias("matches"))


def p_validated(spark, sf_dir):
    """Tiles in lower case with a space and quotes in them, normalized again."""
    p = F.lower("primer")
    odd = F.concat(F.lit("'"), F.substring(p, 1, 3), F.lit(" "), F.substring(p, 4, 100), F.lit('"'))
    return tiles(spark, sf_dir).select("record", "at", al.validated(odd).alias("primer"))


def s_fasta(spark, sf_dir):
    """Documents written as FASTA, in lower case and lines of 60 bases, and read again."""
    folder = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    lines = F.concat(F.lit(">"), F.col("record"), F.lit(" a document\n"), F.lower(F.regexp_replace("seq", "(.{60})", "$1\n")))
    records(spark, sf_dir).where("seq is not null").select(lines.alias("value")).write.text(folder)
    return fasta.read_fasta(spark, folder).select("record", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


def s_wrap_chunks(spark, sf_dir):
    rows = fasta.wrapped_chunks(records(spark, sf_dir), 1000)
    return rows.select("record", F.col("at").cast("long").alias("at"), F.md5("seq").alias("digest"), "is_wrap", "is_last")


def s_panel(spark, sf_dir):
    lines = ["# a panel", "p1 acgtac GGTACC", "p2\tTTACTA\tGCNAG\t10\t200", "", "p3 ACG CGT 5"]
    return panel.panel_table(spark, panel.parse_panel(lines))


def s_chunk_policy(spark, sf_dir):
    asked = [(s, m, 20, c) for s in (0, 100, 5000) for m in (0, 100, 2000) for c in (False, True)]
    rows = [(*x, *fasta.chunk_policy(*x)[:2]) for x in asked]
    return spark.createDataFrame(rows, "size int, longest int, primer int, circular boolean, chunk int, overlap int")


def w_unique_self(spark, sf_dir):
    pairs = [panel.pair("a", "ACGT", "TTAC"), panel.pair("b", "TTAC", "ACGT"), panel.pair("c", "GGC", "ACGT")]
    return panel.panel_table(spark, panel.with_unique_self_pairs(pairs)).select("pair_id", "fwd", "rev")


def d_distinct_pools(spark, sf_dir):
    return panel.panel_table(spark, panel.from_pools(["ACTA", "acta", "TTAC"], ["GCNA", "gcn a"], 10, 90)).select("pair_id", "fwd", "rev", "min_length", "max_length")


def f_concentration(spark, sf_dir):
    texts = ["50mM", "250 nM", "3uM", "3µM", "0.05", "1M"]
    return spark.createDataFrame([(t, round(thermo.concentration(t) * 1e9, 3)) for t in texts], "text string, nanomolar double")


def o_global_order(spark, sf_dir):
    """Places in the whole output, by coordinates."""
    rows = _products(records(spark, sf_dir), [SHORT], most=90, mm=0, window=0)
    return numbered(rows, coordinate_order(rows)).select("record", "start", "end", "type", F.col("n").cast("long").alias("n"))


def o_global_score(spark, sf_dir):
    """Places in the whole output, best score first."""
    rows = placed_scores(scoring.scored(_sites(spark, sf_dir, [THERMO])))
    return scoring.numbered_by_score(rows).select("record", "start", "end", "type", "score", F.col("rank").cast("long").alias("n"))


def _scored_wire(spark, sf_dir):
    return scoring.scored(_sites(spark, sf_dir, [THERMO])).withColumns({"source_file": F.lit("items.fa"), "sequence_id": F.col("record")})


def k_score_tsv(spark, sf_dir):
    return sinks.tsv_lines(_scored_wire(spark, sf_dir).withColumn("score", F.round("score", 6)), sinks.with_score(sinks.PRODUCT))


def k_probe_tsv(spark, sf_dir):
    return sinks.tsv_lines(annotate.with_probe(_wire(spark, sf_dir), "x", "ACTAC", 1), sinks.PROBE)


def k_probe_fasta(spark, sf_dir):
    rows = annotate.with_probe(_wire(spark, sf_dir), "x", "ACTAC", 1)
    return sinks.fasta_lines(numbered(rows, coordinate_order(rows)), "probe")


def k_nested_tsv(spark, sf_dir):
    return sinks.tsv_lines(annotate.with_nested(_wire(spark, sf_dir), [panel.pair("inner", "TAG", "CAC")]), sinks.NESTED)


def k_pretty(spark, sf_dir):
    rows = scoring.with_sites(_sites(spark, sf_dir, [SHORT]))
    return pretty.blocks(rows).select("record", "start", "end", "type", "block")


def k_details_tsv(spark, sf_dir):
    """The lines of 113 columns; t_details has values behind them."""
    return details.detail_lines(details.with_details(_scored_wire(spark, sf_dir)))


def k_thermo_json(spark, sf_dir):
    rows = details.with_details(_scored_wire(spark, sf_dir))
    return sinks.json_lines(rows.withColumn("thermo", details.thermo_struct(rows)))


#: Terms of an end in t_details: name, and whether it is a double.
TERMS = (
    ("mismatch_count", False), ("5p_mismatch_count", False), ("3p_mismatch_count", False), ("mismatch_fallback_count", False), ("mismatch_triplet_count", False), ("mismatch_curated_pair_count", False),
    ("mismatch_dg_kcal", True), ("terminal_mismatch_penalty_c", True), ("3p_terminal_mismatch_penalty_c", True), ("terminal_mismatch_dg_kcal", True), ("dangling_end_adjustment_c", True),
)


def t_details(spark, sf_dir):
    got = details.with_details(scoring.scored(_sites(spark, sf_dir, [THERMO])))
    names = lambda e: [(F.round(f"{e}_{x}", 6) if double else F.col(f"{e}_{x}").cast("int")).alias(f"term_{x}") for x, double in TERMS]
    ends = [F.struct(F.lit(e).alias("side"), *names(e), F.col(f"{e}_mismatch_policy").alias("mismatch_policy"), F.col(f"{e}_end_effect_policy").alias("end_effect_policy")) for e in scoring.ENDS]
    return got.select("record", "start", "end", "type", F.inline(F.array(*ends)))


def t_older_auto(spark, sf_dir):
    """The older model with each primer's own denominator."""
    return scoring.older_score(_sites(spark, sf_dir, [THERMO]), "auto").select("record", "start", "end", "type", *_six("score"))


def t_gapped(spark, sf_dir):
    """Tiles less their last base on the complement of the whole tile, and of the tile less two bases: each needs one gap."""
    rows = tiles(spark, sf_dir).where("length(primer) = 20").select("primer").distinct()
    whole = duplex.complement(F.col("primer"))
    rows = rows.select("primer", F.substring("primer", 1, 19).alias("p"), whole.alias("longer"), F.concat(F.substring(whole, 1, 9), F.substring(whole, 11, 9)).alias("shorter"))
    return rows.select("primer", F.round(scoring.gapped_penalty(F.col("p"), F.col("longer")), 6).alias("longer"), F.round(scoring.gapped_penalty(F.col("p"), F.col("shorter")), 6).alias("shorter"))


def t_single_strand(spark, sf_dir):
    return scoring.older_score(_sites(spark, sf_dir, [THERMO]), single_strand=True).select("record", "start", "end", "type", *_six("score"))


_all = (
    p_sites, p_iupac_match, p_validated, s_fasta, s_wrap_chunks, s_panel, s_chunk_policy, w_unique_self, d_distinct_pools, f_concentration, o_global_order, o_global_score,
    k_score_tsv, k_probe_tsv, k_probe_fasta, k_nested_tsv, k_pretty, k_details_tsv, k_thermo_json, t_details, t_older_auto, t_gapped, t_single_strand,
)
QUERIES = {f.__name__: f for f in _all}


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else repr(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({names})"


PLACE = 'record, start, "end", type'
SITES_OF = "left(s, length(fwd)) as fwd_site, reverse(translate(right(s, length(rev)), 'ACGT', 'TGCA')) as rev_site"
THERMO_SCORES = f"select e.*, round(base, 6) as score from ({_scores_sql(_sites_sql(THERMO))}) e"


def _global_sql(rows: str, first: str = "") -> str:
    return f'row_number() over (order by {first}record, start, "end", length, type) as n from ({rows})'


def _pretty_sql() -> str:
    bars = lambda p, bad: f"array_to_string(list_transform(range(0, length({p})), lambda i: case when list_contains(string_split({bad}, ','), cast(i as varchar)) then ' ' when instr('ACGT', substr({p}, i + 1, 1)) > 0 then '|' else '¦' end), '')"
    rows = f"select *, least(95, greatest(length - length(fwd) - length(rev), 0)) as dots, {SITES_OF} from ({_sites_sql(SHORT)})"
    rows = f"select *, greatest(length(fwd) + greatest(dots, length(rev) + 5), length(rev) + greatest(dots, length(fwd) + 5)) as whole from ({rows})"
    pad = "repeat(' ', cast(whole - length(rev) as int))"
    dots = lambda end: f"repeat('.', cast(whole - length({end}) as int))"
    lines = (
        "concat('5''-', fwd, '-3''')",
        f"concat('   ', {bars('fwd', 'fwd_mm_i')}, '-->')",
        f"concat('5''-', fwd_site, {dots('fwd')}, '-3'' # (+)')",
        f"concat('3''-', {dots('rev')}, translate(rev_site, 'ACGT', 'TGCA'), '-5'' # (-)')",
        f"rtrim(concat({pad}, '<--', reverse({bars('rev', 'rev_mm_i')})))",
        f"concat({pad}, '3''-', reverse(rev), '-5''')",
    )
    block = " || ".join(f"'# ' || {x} || chr(10)" for x in lines) + " || '#' || chr(10)"
    return f"select {PLACE}, {block} as block from ({rows})"


def _details_sql() -> str:
    kinds = "map {" + ", ".join(f"'{k}': 1" for k in duplex.triplets()) + "}"
    triplet = f"{kinds}[substr('N' || primer || 'N', i + 1, 3) || substr('N' || target || 'N', i + 1, 3)] is not null"
    known = "instr('ACGT', substr(target, i + 1, 1)) > 0"
    count = lambda f: f"cast(len(list_filter(bad, lambda i: {f})) as int)"
    dangle = "map {" + ", ".join(f"'{k}': {v}" for k, v in duplex.dangling(duplex.DANGLING_5).items()) + "}"
    first, last = (f"(case when list_contains(bad, {at}) then {v} else 0.0 end)" for at, v in (("0", 0.5), ("length(primer) - 1", 1.5)))
    values = {
        "mismatch_count": "cast(len(bad) as int)",
        "5p_mismatch_count": count("i < 3"),
        "3p_mismatch_count": count("i >= length(primer) - 3"),
        "mismatch_fallback_count": count(f"not {known}"),
        "mismatch_triplet_count": count(triplet),
        "mismatch_curated_pair_count": count(f"{known} and not {triplet}"),
        "mismatch_dg_kcal": "penalty * den / 1000",
        "terminal_mismatch_penalty_c": f"{first} + {last}",
        "3p_terminal_mismatch_penalty_c": last,
        "terminal_mismatch_dg_kcal": f"({first} + {last}) * den / 1000",
        "dangling_end_adjustment_c": "-dangling_dg * 1000 / den",
    }
    shown = ", ".join((f"round(cast({values[x]} as double), 6)" if double else values[x]) + f' as "term_{x}"' for x, double in TERMS)
    dangling = f"coalesce(translate(right(primer, 1), 'ACGT', 'TGCA') = right(target, 1) and {dangle}[beside || right(target, 1)] is not null, false)"
    terminal = f"({first} + {last} > 0)"
    end = f"case when {terminal} and {dangling} then '{details.END_POLICIES[3]}' when {dangling} then '{details.END_POLICIES[2]}' when {terminal} then '{details.END_POLICIES[1]}' else '{details.END_POLICIES[0]}' end"
    policy = "case " + " ".join(f"when p = '{k}' then '{v}'" for k, v in details.POLICIES.items()) + " end"
    rows = f"select *, {POLICY} as p from ({_terms_sql(_ends_sql(_sites_sql(THERMO)))})"
    return f"select {PLACE}, side, {shown}, {policy} as mismatch_policy, {end} as end_effect_policy from ({rows})"


def _older_auto_sql() -> str:
    ends = f"select *, abs({DH} * 1000 / ({TM} + 273.15)) as den from ({_ends_sql(_sites_sql(THERMO), False)})"
    cost = f"greatest(0.0, coalesce(list_sum(list_transform({WRONG}, lambda i: {_cost_sql()} * 1000 / den * {WEIGHT})), 0))"
    return f"select {PLACE}, round(-sum({cost}), 6) as score from ({ends}) group by {PLACE}"


def _gapped_sql() -> str:
    """Costs of the pairs before and behind a gap as lists, then the cheapest place of it."""
    table = lambda t: "map {" + ", ".join(f"'{k}': {v}" for k, v in t.items()) + "}"
    weight = lambda i: f"case when {i} >= 16 then 2.0 when {i} < 3 then 1.5 else 1.0 end"

    def costs(t: str, moved: int, places: str) -> str:
        a, b = "substr('N' || p || 'N', i + 1, 3)", f"substr('N' || {t} || 'N', i + {1 + moved}, 3)"
        known = f"coalesce({table(duplex.triplets())}[{a} || {b}], {table(duplex.PAIR)}[{a}[2] || {b}[2]], 1.0)"
        same = f"translate({a}[2], 'ACGT', 'TGCA') = {b}[2]"
        return f"list_transform({places}, lambda i: case when {same} then 0.0 else cast({known} * 1000 / 200.0 * {weight('i')} as double) end)"

    lists = f"{costs('longer', 0, 'range(0, 19)')} as l0, {costs('longer', 1, 'range(0, 19)')} as l1, {costs('shorter', 0, 'range(0, 18)')} as s0, {costs('shorter', -1, 'range(1, 19)')} as s1"
    total = lambda x: f"coalesce(list_sum({x}), 0)"
    # s1 begins with the pair of the primer's second letter
    least = lambda n, first, rest: f"list_min(list_transform(range(0, {n}), lambda k: {total(first)} + 6.0 * ({weight('k')}) + {total(rest)}))"
    primers = f"select distinct primer, left(primer, 19) as p, translate(primer, 'ACGT', 'TGCA') as longer, translate(left(primer, 9) || substr(primer, 11, 9), 'ACGT', 'TGCA') as shorter from ({PRIMERS}) where length(primer) = 20"
    return f"select primer, round({least(20, 'l0[1:k]', 'l1[k + 1:]')}, 6) as longer, round({least(19, 's0[1:k]', 's1[k + 1:]')}, 6) as shorter from (select primer, {lists} from ({primers}))"


def _probe_wire_sql(value: str) -> str:
    outer = f"select p.*, substr(seq, start + 1, length) as s from ({_products_sql(SHORT, DOCS, 0, 0, 0, 90, columns=IDX)}) p join {DOCS} r on p.record = r.record"
    rows = f"select o.*, b.probe_found, b.probe_strand, b.probe_pos, b.probe_mm, b.probe_site from ({outer}) o join ({_probe_sql()}) b using ({PLACE})"
    return f'select {value} as value from (select *, row_number() over (order by record, start, "end", length, type) as n from ({rows}))'


def _or_empty(*columns: str) -> str:
    return ", ".join(f"coalesce(cast({c} as varchar), '')" for c in columns)


WIRE = "'items.fa', record, experiment_id, start, \"end\", length, type, fwd_mm, rev_mm, fwd_mm_i, rev_mm_i"
NONE_OR_0 = "case when inner_found then '0' else '' end"
ORACLE_SQL = {
    "p_sites": f"select {PLACE}, {SITES_OF} from ({_sites_sql(SHORT)})",
    "p_iupac_match": f"with l as ({_values([(c, al.BASES.get(c, '')) for c in al.LETTERS + 'U'], 'c, bases')}) select a.c as p, b.c as g, a.c <> 'U' and b.c <> 'U' and len(list_intersect(string_split(a.bases, ''), string_split(b.bases, ''))) > 0 as matches from l a, l b",
    "p_validated": PRIMERS,
    "s_fasta": f"select record, cast(length(seq) as bigint) as len, md5(seq) as digest from {DOCS} where seq is not null",
    "s_wrap_chunks": f'select record, cast(a as bigint) as "at", md5(substr(seq, a + 1, 1000)) as digest, false as is_wrap, length(seq) <= 1000 as is_last from (select record, seq, unnest(range(0, greatest(length(seq), 1), 1000)) as a from {DOCS}) union all select record, length(seq) - 1000, md5(right(seq, 1000)), true, true from {DOCS} where length(seq) > 1000',
    "s_panel": _values([(0, "p1", "ACGTAC", "GGTACC", 0, 0), (1, "p2", "TTACTA", "GCNAG", 10, 200), (2, "p3", "ACG", "CGT", 5, 0)], "pair_ord, pair_id, fwd, rev, min_length, max_length"),
    "s_chunk_policy": "select cast(size as int) as size, cast(longest as int) as longest, 20 as primer, circular, cast(case when ok then size else 0 end as int) as chunk, cast(case when ok then longest else 0 end as int) as overlap from (select *, size > 0 and not circular and longest > 0 and size > longest as ok from (select unnest([0, 100, 5000]) as size) cross join (select unnest([0, 100, 2000]) as longest) cross join (select unnest([false, true]) as circular))",
    "w_unique_self": _values([("a", "ACGT", "TTAC"), ("b", "TTAC", "ACGT"), ("c", "GGC", "ACGT"), ("a+A:self", "ACGT", "ACGT"), ("a+B:self", "TTAC", "TTAC"), ("c+A:self", "GGC", "GGC")], "pair_id, fwd, rev"),
    "d_distinct_pools": _values([("F1+R1", "ACTA", "GCNA", 10, 90), ("F2+R1", "TTAC", "GCNA", 10, 90)], "pair_id, fwd, rev, min_length, max_length"),
    "f_concentration": "select text, cast(nanomolar as double) as nanomolar from (" + _values([("50mM", 5e7), ("250 nM", 250.0), ("3uM", 3000.0), ("3µM", 3000.0), ("0.05", 5e7), ("1M", 1e9)], "text, nanomolar") + ")",
    "o_global_order": f"select {PLACE}, {_global_sql(PLAIN)}",
    "o_global_score": f"select {PLACE}, score, {_global_sql(THERMO_SCORES, 'score desc, ')}",
    "k_score_tsv": f"select concat_ws(chr(9), {WIRE}, regexp_replace(cast(score as varchar), '[.]0$', '')) as value from ({_products_sql(THERMO, DOCS, 1, 0, 0, 90, columns=IDX)}) p join ({THERMO_SCORES}) e using (record, start, \"end\", length, type)",
    "k_probe_tsv": _probe_wire_sql(f"concat_ws(chr(9), {WIRE}, 'x', 'ACTAC', probe_found, {_or_empty('probe_strand', 'probe_pos', 'probe_mm', 'probe_site')})"),
    "k_probe_fasta": _probe_wire_sql("'>' || experiment_id || '_' || n || ' start=' || start || ' end=' || \"end\" || ' len=' || length || ' source_file=items.fa probe=x found=' || probe_found || chr(10) || s"),
    "k_nested_tsv": f"select concat_ws(chr(9), 'items.fa', record, 'p2', start, \"end\", \"end\" - start, type, case when inner_found then 'inner' else '' end, inner_found, {_or_empty('inner_start', 'inner_end', 'inner_length', 'inner_type')}, {NONE_OR_0}, {NONE_OR_0}) as value from ({_nested_sql('left', ', i.record is not null as inner_found')})",
    "k_pretty": _pretty_sql(),
    "t_details": _details_sql(),
    "t_older_auto": _older_auto_sql(),
    "t_gapped": _gapped_sql(),
}
