"""All terms behind an amplicon's score: one table of 113 columns, its lines, and nested JSON.

Each end's mismatches are listed once for each distinct primer and target of a
batch, and counts and labels are taken from that list. Columns that don't apply to
a row are null there, and empty in its line.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import duplex
from ..functions.batched import by_distinct
from ..functions.duplex import Profile
from ..functions.thermo import Conditions
from ..sources.sinks import shortest_of
from .scoring import ENDS, with_targets

#: The columns of details in order; {end} stands for fwd and then rev.
COLUMNS = tuple(
    x.replace("{end}", end)
    for group in (
        "thermo_model salt_model na_m mg_m dntp_m effective_na_m free_mg_m anneal_temp_c iupac_thermo_policy iupac_expansion_count iupac_expansion_capped iupac_effective_variant "
        "score_profile base_score_c final_score_c amplicon_adjustment_c extension_logit extension_bonus_c length_penalty_c band_mass_bonus_c structure_penalty_c limiting_side",
        "{end}_tm_c {end}_margin_c {end}_dg_kcal {end}_mismatch_penalty_c {end}_mismatch_count {end}_3p_mismatch_count {end}_mismatch_fallback_count {end}_mismatch_dg_kcal "
        "{end}_terminal_mismatch_penalty_c {end}_5p_terminal_mismatch_penalty_c {end}_3p_terminal_mismatch_penalty_c {end}_terminal_mismatch_dg_kcal "
        "{end}_dangling_end_adjustment_c {end}_dangling_end_dg_kcal {end}_end_effect_policy",
        "hairpin_penalty_c self_dimer_penalty_c cross_dimer_penalty_c panel_cross_dimer_penalty_c panel_cross_dimer_burden_c panel_cross_dimer_count panel_cross_dimer_partner "
        "probe_found probe_score_mode probe_name probe_seq probe_strand probe_pos probe_mm probe_site probe_tm_c probe_margin_c probe_dg_kcal probe_mismatch_penalty_c probe_mismatch_dg_kcal "
        "probe_iupac_thermo_policy probe_iupac_expansion_count probe_iupac_expansion_capped probe_iupac_effective_variant probe_score_contribution_c probe_gate_penalty_c",
        "{end}_mismatch_policy {end}_mismatch_triplet_count {end}_mismatch_curated_pair_count {end}_mismatch_sources {end}_mismatch_parameter_sets {end}_mismatch_citations {end}_mismatch_parameter_notes",
        "probe_mismatch_count probe_mismatch_fallback_count probe_mismatch_triplet_count probe_mismatch_curated_pair_count probe_mismatch_policy "
        "probe_mismatch_sources probe_mismatch_parameter_sets probe_mismatch_citations probe_mismatch_parameter_notes",
        "{end}_terminal_mismatch_sources {end}_terminal_mismatch_parameter_sets {end}_terminal_mismatch_citations {end}_terminal_mismatch_parameter_notes",
        "probe_terminal_mismatch_sources probe_terminal_mismatch_parameter_sets probe_terminal_mismatch_citations probe_terminal_mismatch_parameter_notes",
    )
    for name in group.split()
    for end in (ENDS if "{end}" in name else ("",))
    for x in (name,)
)
#: Labels of models and of where a cost comes from.
MODELS = ("nn-duplex-v1", "nn-structure-v1")
POLICIES = {"perfect": "nn-perfect", "triplet": "nn-imperfect-v1-with-triplet-ddg", "pair": "nn-imperfect-v1-with-curated-pair-ddg", "unknown base": "nn-imperfect-v1-with-heuristic-ddg-fallback"}
END_POLICIES = ("none", "nn-terminal-mismatch-v1", "nn-template-dangling-end-v1", "nn-terminal-mismatch-template-dangling-v1")
SOURCES = {"triplet": "triplet-ddg", "pair": "curated-pair-ddg-v1", "unknown": "heuristic-ddg-fallback"}
PARAMETER_SETS = {"triplet": "santalucia-hicks-2004-internal-mismatch-compiled-dimer-gauge-v1", "pair": "pair-family-v1", "terminal": "terminal-mismatch-heuristic-v1"}
TERMINAL_SOURCE, CITATION = "terminal-mismatch-heuristic", "SantaLucia and Hicks 2004, doi:10.1146/annurev.biophys.32.110601.141800"
NOTES = {"triplet": "mismatch between matched pairs, from published dimers", "pair": "default of the pair's family", "terminal": "fixed degrees at a primer's last base"}


END_FIELD_TYPES = [
    *(pa.field(x, pa.int32()) for x in ("mismatch_count", "5p_mismatch_count", "3p_mismatch_count", "mismatch_fallback_count", "mismatch_triplet_count", "mismatch_curated_pair_count")),
    *(pa.field(x, pa.float64()) for x in ("5p_terminal_mismatch_penalty_c", "3p_terminal_mismatch_penalty_c")),
    *(pa.field(x, pa.string()) for x in ("mismatch_sources", "mismatch_parameter_sets", "mismatch_citations", "mismatch_parameter_notes")),
]


def mismatch_terms(primer: str | None, target: str | None) -> tuple:
    """END_FIELD_TYPES of one primer and target."""
    costs, n = duplex.mismatch_costs(primer, target), len(primer or "")
    count = lambda f: sum(map(f, costs))
    kinds = dict.fromkeys("triplet" if m.triplet else "pair" if m.known else "unknown" for m in costs)
    labels = lambda table: "|".join(table[k] for k in kinds if k in table)
    return (
        len(costs), count(lambda m: m.i < duplex.END), count(lambda m: m.i >= n - duplex.END), count(lambda m: not m.known), count(lambda m: m.triplet), count(lambda m: m.known and not m.triplet),
        duplex.LAST_5 if any(m.i == 0 and n > 1 for m in costs) else 0.0, duplex.LAST_3 if any(m.i == n - 1 for m in costs) else 0.0,
        labels(SOURCES), labels(PARAMETER_SETS), labels({"triplet": CITATION}), labels(NOTES),
    )


def end_terms(primer: Column, target: Column, denominator: Column, penalty: Column, dangling_dg: Column, dangling: Column) -> dict[str, Column]:
    """The terms of one end by their column's name behind the end's; dangling: whether a base beside the primer counts."""

    @F.arrow_udf(", ".join(f"`{x.name}` {'int' if x.type == pa.int32() else 'double' if x.type == pa.float64() else 'string'}" for x in END_FIELD_TYPES))
    def of(p: pa.Array, t: pa.Array) -> pa.Array:
        return by_distinct(mismatch_terms, END_FIELD_TYPES, p, t)

    found = of(primer, target)
    first, last = found["5p_terminal_mismatch_penalty_c"], found["3p_terminal_mismatch_penalty_c"]
    terminal = (first + last) > 0
    at_end = lambda text: F.when(terminal, text).otherwise("")
    return {x.name: found[x.name] for x in END_FIELD_TYPES} | {
        "mismatch_dg_kcal": penalty * denominator / 1000, "terminal_mismatch_penalty_c": first + last,
        "terminal_mismatch_dg_kcal": (first + last) * denominator / 1000, "dangling_end_adjustment_c": -dangling_dg * 1000 / denominator, "dangling_end_dg_kcal": dangling_dg,
        "end_effect_policy": F.when(terminal & dangling, END_POLICIES[3]).when(dangling, END_POLICIES[2]).when(terminal, END_POLICIES[1]).otherwise(END_POLICIES[0]),
        "terminal_mismatch_sources": at_end(TERMINAL_SOURCE), "terminal_mismatch_parameter_sets": at_end(PARAMETER_SETS["terminal"]), "terminal_mismatch_citations": F.lit(""), "terminal_mismatch_parameter_notes": at_end(NOTES["terminal"]),
    }


def policy_label(policy: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in POLICIES.items() for x in kv])[policy]


def amplicon_terms(profile: Profile) -> dict[str, Column]:
    """How the profile moves a score; all 0 for the binding profile."""
    margin, length, zero = F.col("base_score"), F.col("length").cast("double"), F.lit(0.0)
    if profile.kind == "binding":
        terms = {"extension_logit": zero, "extension_bonus_c": zero, "length_penalty_c": zero, "band_mass_bonus_c": zero}
    else:
        logit = duplex.extension_logit(margin, profile.extension_alpha)
        band = F.when(length > 0, profile.band_weight * F.log(length / duplex.BAND_BP) / math.log(2)).otherwise(0.0) if profile.kind == "gel" else zero
        terms = {"extension_logit": logit, "extension_bonus_c": profile.extension_weight * logit, "length_penalty_c": duplex.length_penalty(length, profile), "band_mass_bonus_c": band}
    return {"amplicon_adjustment_c": terms["extension_bonus_c"] - terms["length_penalty_c"] + terms["band_mass_bonus_c"], **terms}


def with_details(rows: DataFrame, c: Conditions = Conditions(), profile: Profile = Profile(), probe_mode: str = "") -> DataFrame:
    """rows as scored(), with_structures() or with_probe_score() give them, and the columns of details that they don't have yet.

    A column of rows with a name of details stays as it is.
    """
    got = with_targets(rows)
    has = set(rows.columns)
    out: dict[str, Column] = {
        "thermo_model": F.lit(MODELS["structure_c" in has]), "salt_model": F.lit(c.model), "na_m": F.lit(c.na), "mg_m": F.lit(c.mg), "dntp_m": F.lit(c.dntp),
        "effective_na_m": F.lit(float(c.sodium())), "free_mg_m": F.lit(float(c.free_mg())), "anneal_temp_c": F.lit(float(c.anneal_c)),
        "score_profile": F.lit(profile.kind), "base_score_c": F.col("base_score"), "final_score_c": F.col("score"), **amplicon_terms(profile),
        "structure_penalty_c": F.col("structure_c") if "structure_c" in has else F.lit(0.0),
    }
    for end in ENDS:
        target, beside = F.col(f"{end}_target"), F.col(f"{end}_beside")
        known = duplex.lookup(duplex.dangling(duplex.DANGLING_5), F.concat(beside, F.right(target, F.lit(1)))).isNotNull()
        dangling = known & (duplex.complement(F.right(F.col(end), F.lit(1))) == F.right(target, F.lit(1)))
        terms = end_terms(F.col(end), target, F.col(f"{end}_denominator"), F.col(f"{end}_penalty"), F.col(f"{end}_dangling_dg"), F.coalesce(dangling, F.lit(False)))
        out |= {f"{end}_{k}": v for k, v in terms.items()}
        out |= {f"{end}_tm_c": F.col(f"{end}_tm"), f"{end}_margin_c": F.col(f"{end}_margin"), f"{end}_dg_kcal": F.col(f"{end}_dg"), f"{end}_mismatch_penalty_c": F.col(f"{end}_penalty"), f"{end}_mismatch_policy": policy_label(F.col(f"{end}_policy"))}
    for name, column in (("hairpin_penalty_c", "hairpin_c"), ("self_dimer_penalty_c", "self_dimer_c"), ("cross_dimer_penalty_c", "cross_dimer_c"), ("panel_cross_dimer_penalty_c", "panel_c"), ("panel_cross_dimer_burden_c", "panel_burden_c"), ("panel_cross_dimer_count", "panel_count"), ("panel_cross_dimer_partner", "panel_partner"), ("probe_tm_c", "probe_tm"), ("probe_margin_c", "probe_margin"), ("probe_dg_kcal", "probe_dg")):
        if column in has:
            out[name] = F.col(column)
    if "probe_found" in has:
        out["probe_score_mode"] = F.lit(probe_mode)
    counts = {f"{end}_dangling_count": F.col(f"{end}_end_effect_policy").isin(*END_POLICIES[2:]).cast("int") for end in ENDS}
    got = got.withColumns({k: v for k, v in out.items() if k not in has}).withColumns(counts)
    none = {x: F.lit(None).cast("string") for x in COLUMNS if x not in got.columns}
    return got.withColumns(none).drop(*[f"{end}_{x}" for end in ENDS for x in ("target", "beside")])


def detail_value(rows: DataFrame) -> Column:
    """The 113 columns of with_details() as a line: doubles in their shortest form, counts of 0 empty."""
    types = dict(rows.dtypes)
    double = [types[x] == "double" for x in COLUMNS]

    def cell(name: str) -> Column:
        c = F.col(name)
        text = F.when(c.cast("int") != 0, c.cast("string")) if name.endswith("_count") else c.cast("string")
        return c if types[name] == "double" else F.coalesce(text, F.lit(""))

    @F.arrow_udf("string")
    def line(*cells: pa.Array) -> pa.Array:
        texts = [_written(x) if d else x for x, d in zip(cells, double, strict=True)]
        return pc.binary_join_element_wise(*texts, "\t")

    return line(*map(cell, COLUMNS))


def _written(values: pa.Array) -> pa.Array:
    """shortest_of() of doubles, null as empty; each distinct one of the batch once."""
    d = values.dictionary_encode()
    texts = pa.array([shortest_of(x) for x in d.dictionary.to_pylist()], pa.string())
    return texts.take(d.indices).fill_null("")


def detail_lines(rows: DataFrame) -> DataFrame:
    return rows.select(detail_value(rows).alias("value"))


#: Fields of an end's object in order, those from the colon on left out where they are 0, empty or false.
END_FIELDS = (
    "side tm_c anneal_margin_c delta_g_at_anneal_kcal mismatch_penalty_c: mismatch_delta_g_kcal terminal_mismatch_penalty_c terminal_mismatch_delta_g_kcal dangling_end_adjustment_c dangling_end_delta_g_kcal dangling_end_count "
    "mismatch_count five_prime_mismatch_count three_prime_mismatch_count five_prime_terminal_mismatch_penalty_c three_prime_terminal_mismatch_penalty_c mismatch_fallback_count mismatch_triplet_count mismatch_curated_pair_count"
)
#: Where a field's value is, if not under its own name.
FROM = {
    "anneal_margin_c": "margin_c", "delta_g_at_anneal_kcal": "dg_kcal", "mismatch_delta_g_kcal": "mismatch_dg_kcal", "terminal_mismatch_delta_g_kcal": "terminal_mismatch_dg_kcal", "dangling_end_delta_g_kcal": "dangling_end_dg_kcal",
    "dangling_end_count": "dangling_count", "five_prime_mismatch_count": "5p_mismatch_count", "three_prime_mismatch_count": "3p_mismatch_count", "five_prime_terminal_mismatch_penalty_c": "5p_terminal_mismatch_penalty_c", "three_prime_terminal_mismatch_penalty_c": "3p_terminal_mismatch_penalty_c",
}
THERMO_FIELDS = (
    "model salt_model: na_m mg_m dntp_m effective_na_m free_mg_m; anneal_temp_c iupac_policy mismatch_policy: score_profile; score_c: base_score_c amplicon_adjustment_c extension_logit extension_bonus_c length_penalty_c band_mass_bonus_c structure_penalty_c; limiting_side"
)


def thermo_struct(rows: DataFrame) -> Column:
    """The nested object of with_details(): conditions, score terms, both ends, and structures' penalties where rows have them."""
    types = dict(rows.dtypes)
    some = lambda c, t: F.when(c != (F.lit("") if t == "string" else F.lit(0)), c)

    def end_struct(end: str) -> Column:
        always, _, rest = END_FIELDS.partition(":")
        of = lambda x: f"{end}_{FROM.get(x, x)}"
        fields = [F.lit(end).alias("side")] + [F.col(of(x)).alias(x) for x in always.split()[1:]] + [some(F.col(of(x)), types[of(x)]).alias(x) for x in rest.split()]
        lists = [F.when(F.col(f"{end}_{x}") != "", F.split(f"{end}_{x}", r"\|")).alias(x) for x in ("mismatch_sources", "mismatch_parameter_sets", "mismatch_citations", "mismatch_parameter_notes", "terminal_mismatch_sources", "terminal_mismatch_parameter_sets", "terminal_mismatch_parameter_notes")]
        wrong = F.col(f"{end}_mismatch_count") > 0
        tail = [F.col(f"{end}_denominator").alias("effective_denom_cal_per_k_mol"), F.col(f"{end}_mismatch_policy").alias("mismatch_policy"), F.col(f"{end}_end_effect_policy").alias("end_effect_policy"), wrong.alias("has_non_watson_crick"), (F.col(f"{end}_mismatch_fallback_count") > 0).alias("used_heuristic_adjust")]
        return F.struct(*fields, *lists, *tail).alias(end)

    given = {"model": F.col("thermo_model"), "iupac_policy": F.lit("strict-acgt"), "mismatch_policy": F.lit("nn-perfect-or-nn-imperfect-v1"), "score_c": F.col("final_score_c")}
    fields, always = [], True
    for token in THERMO_FIELDS.replace(":", " : ").replace(";", " ; ").split():
        if token in ":;":
            always = token == ";"
            continue
        value = given.get(token, F.col(token) if token in types else None)
        fields.append((value if always else some(value, types.get(token, "double"))).alias(token))
    fields += [end_struct(end) for end in ENDS]
    fields += [some(F.col(x), types[x]).alias(x) for x in ("panel_cross_dimer_penalty_c", "panel_cross_dimer_burden_c", "panel_cross_dimer_count") if types[x] != "string"]
    return F.struct(*fields).alias("thermo")


def with_variants(rows: DataFrame, enumerated: DataFrame, keys: tuple[str, ...], count: str = "variants") -> DataFrame:
    """rows with iupac_expansion_count and iupac_effective_variant of by_policy()'s rows: `fwd/rev` of the variant that counts, empty for means."""
    label = F.when(F.col("fwd").isNotNull(), F.concat_ws("/", "fwd", "rev")).otherwise("")
    return rows.join(enumerated.select(*keys, F.col(count).alias("iupac_expansion_count"), label.alias("iupac_effective_variant")), list(keys))
