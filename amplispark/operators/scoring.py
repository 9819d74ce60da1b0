"""Scores of amplicons by how well both primers bind, with IUPAC policies and ranks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import duplex, thermo
from ..functions.alphabet import expansions, normalized, revcomp
from ..functions.batched import by_distinct, laid_end_to_end, sums
from ..functions.duplex import Profile
from ..functions.structure import penalty_of, structure, structure_of
from ..functions.thermo import Conditions
from ..session import small
from .annotate import with_probe
from .panel import Pair, panel_table
from .products import coordinate_order, numbered, ranked

KEY = ("record", "pair_ord", "start", "end", "type", "is_wrap")
POLICIES = ("strict", "worst", "best", "mean", "enumerate")
ENDS = ("fwd", "rev")


def with_primers(rows: DataFrame, pairs: list[Pair]) -> DataFrame:
    """rows with fwd and rev, the primers at the left and right end; a revcomp amplicon has them swapped."""
    bounds = panel_table(rows.sparkSession, pairs).select("pair_ord", F.col("fwd").alias("a"), F.col("rev").alias("b"))
    forward = F.col("type") == "forward"
    got = rows.join(small(bounds, len(pairs)), "pair_ord")
    return got.withColumns({"fwd": F.when(forward, F.col("a")).otherwise(F.col("b")), "rev": F.when(forward, F.col("b")).otherwise(F.col("a"))}).drop("a", "b")


def with_sites(rows: DataFrame) -> DataFrame:
    """rows (fwd, rev, seq) with the bases that each primer binds, read in the primer's direction."""
    seq = F.col("seq")
    return rows.withColumns({"fwd_site": F.substring(seq, F.lit(1), F.length("fwd")), "rev_site": revcomp(F.right(seq, F.length("rev")))})


def with_targets(rows: DataFrame) -> DataFrame:
    """rows (fwd, rev, seq) with both targets, 3' to 5' under their primers, and the amplicon's bases beside the primers' 3' ends."""
    seq, f, r = F.col("seq"), F.length("fwd"), F.length("rev")
    return rows.withColumns({
        "fwd_target": duplex.complement(F.substring(seq, F.lit(1), f)),
        "rev_target": F.reverse(F.right(seq, r)),
        "fwd_beside": duplex.complement(F.substring(seq, f + 1, F.lit(1))),
        "rev_beside": F.when(F.length(seq) > r, F.substring(seq, F.length(seq) - r, F.lit(1))).otherwise(""),
    })


def scored(rows: DataFrame, c: Conditions = Conditions(), profile: Profile = Profile(), overrides: duplex.Overrides = duplex.Overrides()) -> DataFrame:
    """rows (fwd, rev of plain bases; seq; length) with both ends' terms, limiting_side, base_score and score.

    The base score is the smaller margin over the annealing temperature. It is
    null where a primer has other letters: see by_policy.
    """
    got = duplex.duplexes(with_targets(rows), [(end, f"{end}_target", f"{end}_", f"{end}_beside", "") for end in ENDS], c, overrides)
    fwd, rev = F.col("fwd_margin"), F.col("rev_margin")
    base = F.when(rev < fwd, rev).otherwise(fwd)
    got = got.withColumns({"limiting_side": F.when(rev < fwd, "rev").otherwise("fwd"), "base_score": F.when(fwd.isNotNull() & rev.isNotNull(), base)})
    got = got.withColumn("score", duplex.profiled(F.col("base_score"), F.col("base_score"), F.col("length").cast("double"), profile))
    return got.drop(*[f"{end}_{x}" for end in ENDS for x in ("target", "beside")])


VARIANT = "struct<ord:int,fwd:string,rev:string,score:double>"
CHOSEN = f"variants long, worst {VARIANT}, best {VARIANT}, mean double, all array<{VARIANT}>"


@lru_cache(1 << 12)
def _variants(fwd: str, rev: str, most: int) -> list[tuple[str, str]]:
    """The first `most` pairs of plain sequences that both primers stand for, in order of bases."""
    return [(f, r) for f in expansions(fwd, most) for r in expansions(rev, most)][:most]


def policies(rows: DataFrame, most: int = 256, c: Conditions = Conditions(), profile: Profile = Profile(), every: bool = False) -> DataFrame:
    """rows (fwd, rev, seq, length) with `scores`: the number of variants, the worst and best of them, the mean score and, with every, all.

    Of equal scores the first variant counts, for worst a null score before any
    other. Nothing is shuffled: a row's variants are scored beside each other.
    """

    def of(fwd, rev, fwd_target, rev_target, fwd_beside, rev_beside, length) -> tuple:
        if fwd is None or rev is None:
            return 0, None, None, None, None
        each = []
        for k, (f, r) in enumerate(_variants(fwd, rev, most)):
            a, b = duplex.duplex_of(f, fwd_target, fwd_beside, "", c).margin, duplex.duplex_of(r, rev_target, rev_beside, "", c).margin
            score = None if a is None or b is None else duplex.profiled_value(b if b < a else a, length, profile)
            each.append({"ord": k, "fwd": f, "rev": r, "score": score})
        known = [x for x in each if x["score"] is not None]
        worst = min(each, key=lambda x: (x["score"] is not None, x["score"] or 0.0))
        best = max(known, key=lambda x: x["score"]) if known else each[0]
        mean = sum(x["score"] for x in known) / len(known) if known else None
        return len(each), worst, best, mean, each if every else None

    variant = pa.struct([("ord", pa.int32()), ("fwd", pa.string()), ("rev", pa.string()), ("score", pa.float64())])
    fields = [pa.field("variants", pa.int64()), pa.field("worst", variant), pa.field("best", variant), pa.field("mean", pa.float64()), pa.field("all", pa.list_(variant))]

    @F.arrow_udf(CHOSEN)
    def scores(*columns: pa.Array) -> pa.Array:
        return by_distinct(of, fields, *columns)

    length = F.col("length").cast("double") if profile.kind != "binding" else F.lit(0.0)
    asked = with_targets(rows).select(*rows.columns, scores("fwd", "rev", "fwd_target", "rev_target", "fwd_beside", "rev_beside", length).alias("scores"))
    return asked.where("scores.variants > 0")


def by_policy(rows: DataFrame, policy: str = "worst", most: int = 256, c: Conditions = Conditions(), profile: Profile = Profile()) -> DataFrame:
    """Score of each amplicon over the plain sequences its primers stand for: KEY, score, variants, fwd, rev.

    worst and best give the first such variant and its primers; mean and
    enumerate the mean score and no primers, enumerate the list of all as well.
    strict takes primers as they are. The first `most` variants count, as
    expansion is in order of bases.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy: {policy!r}")
    if policy == "strict":
        return scored(rows, c, profile).select(*KEY, "score", F.lit(1).cast("long").alias("variants"), "fwd", "rev")
    got = policies(rows, most, c, profile, policy == "enumerate")
    if policy in ("worst", "best"):
        return got.select(*KEY, *(F.col(f"scores.{x}").alias(x.rpartition(".")[2]) for x in (f"{policy}.score", "variants", f"{policy}.fwd", f"{policy}.rev")))
    no = F.lit(None).cast("string")
    every = [F.col("scores.all").alias("all")] if policy == "enumerate" else []
    return got.select(*KEY, F.col("scores.mean").alias("score"), F.col("scores.variants").alias("variants"), *every, no.alias("fwd"), no.alias("rev"))


def score_order(rows: DataFrame | None = None) -> list[Column]:
    """Highest score first, NaN and then null last, ties by coordinates."""
    return [F.col("score").isNull(), F.isnan("score"), F.desc("score"), *coordinate_order(rows)]


def ranked_by_score(rows: DataFrame) -> DataFrame:
    """Place of each amplicon within its record, best score first."""
    return ranked(rows, score_order(rows))


def numbered_by_score(rows: DataFrame) -> DataFrame:
    """Place of each amplicon in the whole output, best score first."""
    return numbered(rows, score_order(rows), "rank")


#: Degrees of a gap in the older model, by place as a mismatch is; what a base at a primer's end gives on a single strand,
#: and degrees a kcal/mol of the target's own hairpin, at most so many.
GAP, SINGLE_END, HAIRPIN, MOST_HAIRPIN = 6.0, {"A": 0.10, "T": 0.10, "C": 0.20, "G": 0.20}, 1.5, 6.0


def auto_denominator(primer: Column, c: Conditions = Conditions()) -> Column:
    """What turns kcal/mol into degrees for a primer, from its own perfect duplex; 200 where it isn't of plain bases."""
    plain = F.when(primer.rlike("^[ACGT]{2,}$"), primer)
    found = F.abs(thermo.enthalpy(plain) * 1000 / (thermo.tm(plain, c) + 273.15))
    return F.coalesce(F.when(~F.isnan(found) & (found > 0), found), F.lit(200.0))


#: Letters of one strand and places of a gap that are compared at once.
GAPPED_CELLS = 1 << 20


@lru_cache(1)
def _costs_by_codes() -> np.ndarray:
    """kcal/mol of a pair among its neighbours, 0 if matched, by the codes of three letters of A, C, G, T, N of the primer and three of the target."""
    out = np.zeros((5,) * 6)
    for k in np.ndindex(out.shape):
        a, b = ("".join("ACGTN"[x] for x in k[i : i + 3]) for i in (0, 3))
        bad = duplex.mismatch_costs(a, b)
        out[k] = next((m.cost for m in bad if m.i == 1), 0.0)
    return out


def _one_gap(p: np.ndarray, t: np.ndarray, d: np.ndarray, gaps: bool) -> np.ndarray:
    """gapped_penalty() of rows of codes, of one length each, targets one letter longer or shorter."""
    rows, n = p.shape
    longer, table = t.shape[1] > n, _costs_by_codes()
    top, low = (np.pad(x, ((0, 0), (1, 1)), constant_values=4) for x in (p, t))
    weights = np.array([duplex.weight(i, n) for i in range(n + 1)])

    def degrees(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the pairs of p[i] and t[j]."""
        cost = table[top[:, i], top[:, i + 1], top[:, i + 2], low[:, j], low[:, j + 1], low[:, j + 2]]
        bad = np.where(d[:, None] <= 0, duplex.NO_DENOMINATOR_C, cost * 1000 / np.where(d[:, None] <= 0, 1.0, d[:, None]))
        return np.where(p[:, i] + t[:, j] == 3, 0.0, bad) * weights[i]

    same = np.arange(min(n, t.shape[1]))
    moved = 0 if longer else 1
    behind = np.arange(moved, n)
    last = n if longer else n - 1
    zero = np.zeros((rows, 1))
    before = np.concatenate([zero, np.cumsum(degrees(same, same), 1)], 1) if len(same) else zero
    after = np.concatenate([np.cumsum(degrees(behind, behind + (1 if longer else -1))[:, ::-1], 1)[:, ::-1], zero], 1) if len(behind) else zero
    places = np.arange(last + 1) if gaps else np.array([last])
    return (before[:, places] + GAP * weights[places] + after[:, places]).min(1)


def gapped_of(p: str, t: str, d: float, gaps: bool = True) -> float:
    """gapped_penalty() of one primer and target of any letters."""
    n, m = len(p), len(t)
    if abs(n - m) != 1:
        return duplex.old_penalty_of(p, t, d) if n == m else 0.0
    longer = m > n
    moved, last = (0, n) if longer else (1, n - 1)
    before = [(x.i, duplex.degrees_of(x, d) * duplex.weight(x.i, n)) for x in duplex.mismatch_costs(p, t)]
    after = [(x.i + moved, duplex.degrees_of(x, d) * duplex.weight(x.i + moved, n)) for x in duplex.shifted_costs(p, t, longer)]
    return min(sum(c for i, c in before if i < k) + GAP * duplex.weight(k, n) + sum(c for i, c in after if i >= k + moved) for k in (range(last + 1) if gaps else [last]))


def _gapped(primers: pa.Array, targets: pa.Array, denominators: np.ndarray, gaps: bool) -> np.ndarray:
    """Rows of plain bases are compared as arrays, by both lengths; others one by one."""
    (p, p_begin, n), (t, t_begin, m) = laid_end_to_end(primers), laid_end_to_end(targets)
    out, simple = np.zeros(len(n)), (np.abs(n - m) == 1) & (n > 0) & (m > 0)
    for codes, begin, size in ((p, p_begin, n), (t, t_begin, m)):
        simple &= sums(codes > 3, begin, size) == 0
    for x, y in {*zip(n[simple].tolist(), m[simple].tolist(), strict=True)}:
        rows = np.flatnonzero(simple & (n == x) & (m == y))
        for part in np.array_split(rows, -(-len(rows) * (x + 1) // GAPPED_CELLS) or 1):
            out[part] = _one_gap(p[p_begin[part, None] + np.arange(x)], t[t_begin[part, None] + np.arange(y)], denominators[part], gaps)
    rest = np.flatnonzero(~simple)
    take = pa.array(rest)
    for k, a, b in zip(rest.tolist(), primers.take(take).to_pylist(), targets.take(take).to_pylist(), strict=True):
        out[k] = 0.0 if a is None or b is None else gapped_of(a, b, float(denominators[k]), gaps)
    return out


def gapped_penalty(primer: Column, target: Column, denominator: Column | float = 200.0, gaps: bool = True) -> Column:
    """The older model's penalty where the target is one base longer or shorter: one gap, at its cheapest place.

    Without gaps it can only be behind all pairs. Lengths further apart cost nothing, as in that model.
    """

    @F.arrow_udf("double")
    def of(p: pa.Array, t: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array(_gapped(p, t, d.to_numpy(zero_copy_only=False), gaps))

    return of(primer, target, denominator if isinstance(denominator, Column) else F.lit(float(denominator)))


def older_score(rows: DataFrame, denominator: float | str = 200.0, gaps: bool = False, single_strand: bool = False, c: Conditions = Conditions()) -> DataFrame:
    """rows with the older model's score, 0 for two perfect sites of which the right one reads as its own complement.

    It lays the right primer on the complement of its site without turning it
    round; that peculiarity is kept. With denominator "auto" each primer has its
    own. On a single strand an end gains a little by its base, and the target's
    own hairpin costs. A site is as long as its primer, so gaps only count for
    targets given to gapped_penalty() itself.
    """
    seq = F.col("seq")
    sides = {"fwd": duplex.complement(F.substring(seq, F.lit(1), F.length("fwd"))), "rev": duplex.complement(F.right(seq, F.length("rev")))}
    total = F.lit(0.0)
    got = rows.withColumns({f"{end}_older_target": target for end, target in sides.items()})
    hairpin = structure_of("hairpin", "stem", Conditions())
    for end in ENDS:
        p, t = F.col(end), F.col(f"{end}_older_target")
        d = auto_denominator(p, c) if denominator == "auto" else denominator
        cost = gapped_penalty(p, t, d) if gaps else duplex.old_penalty(p, t, d)
        if single_strand:
            ends = F.create_map(*[F.lit(x) for kv in SINGLE_END.items() for x in kv])
            bonus = sum((F.coalesce(ends[F.substring(p, at, 1)], F.lit(0.0)) for at in (1, -1)), F.lit(0.0))
            got = got.withColumn(f"{end}_hairpin_dg", hairpin(F.when(t.rlike("^[ACGT]+$"), F.reverse(t)))["dg"])
            own = F.greatest(F.lit(0.0), F.least(F.lit(MOST_HAIRPIN), -HAIRPIN * F.coalesce(F.col(f"{end}_hairpin_dg"), F.lit(0.0))))
            cost = F.when(p.rlike("^[ACGT]+$"), F.greatest(F.lit(0.0), cost - bonus + own)).otherwise(0.0)
        total = total + cost
    return got.withColumn("score", -total).select(*rows.columns, *(() if "score" in rows.columns else ("score",)))


def panel_primers(pairs: list[Pair], most: int = 256) -> list[tuple[str, str]]:
    """(id, plain sequence) of all primers of a panel, each sequence once."""
    seen: dict[str, str] = {}
    for p in pairs:
        for side, seq in (("A", p.forward), ("B", p.reverse)):
            variants = expansions(seq, most)
            for v in variants:
                seen.setdefault(v, f"{p.id}+{side}" + (f"[{v}]" if len(variants) > 1 else ""))
    return [(name, seq) for seq, name in seen.items()]


@lru_cache(1 << 12)
def _structures(fwd: str, rev: str, partners: tuple[tuple[str, str], ...], mode: str, c: Conditions) -> tuple[list, list]:
    """(kind, whose, structure) of both primers' hairpins, self dimers and cross dimer, and (whose, partner, structure) of dimers with the partners' primers."""
    f, r = (fwd, None), (rev, None)
    asked = [("hairpin", "fwd", f), ("hairpin", "rev", r), ("self-dimer", "fwd", f), ("self-dimer", "rev", r), ("cross-dimer", "both", (fwd, rev))]
    own = [(kind, end, found) for kind, end, pair in asked if (found := structure(kind, mode, *pair, c))]
    panel = [(end, name, found) for end, q in (("fwd", fwd), ("rev", rev)) for name, seq in sorted(partners) if seq not in (fwd, rev) and (found := structure("cross-dimer", mode, q, seq, c))]
    return own, panel


COSTS = [*(pa.field(x, pa.float64()) for x in ("hairpin_c", "self_dimer_c", "cross_dimer_c", "panel_c")), pa.field("panel_partner", pa.string()), pa.field("panel_count", pa.int32()), pa.field("panel_burden_c", pa.float64())]


def with_structures(rows: DataFrame, pairs: list[Pair] = (), c: Conditions = Conditions(), profile: Profile = Profile(), scale: float = 1.0, mode: str = "ensemble") -> DataFrame:
    """rows as scored() gives them, with what structures of the primers cost and the score less that.

    Added are hairpin_c, self_dimer_c and cross_dimer_c (sums of both primers'
    and the worse side's degrees), panel_c, panel_count, panel_burden_c and
    panel_partner of the worst dimer with a primer of pairs, structure_c and score.
    """
    if scale < 0:
        raise ValueError("the scale can't be negative")
    partners = tuple(panel_primers(list(pairs))) if pairs else ()

    def costs(fwd, rev, fwd_dg, rev_dg, fwd_denominator, rev_denominator) -> tuple:
        own, panel = _structures(fwd, rev, partners, mode, c)
        binding = {"fwd": (fwd_dg, fwd_denominator), "rev": (rev_dg, rev_denominator)}
        sums = dict.fromkeys(("hairpin", "self-dimer"), 0.0)
        for kind, end, found in own:
            if end != "both":
                sums[kind] += penalty_of(kind, found, *binding[end])
        cross = max((penalty_of(kind, found, *binding[end]) for kind, whose, found in own if whose == "both" for end in ENDS), default=0.0)
        dimers = [(cost, -found.dg, name) for end, name, found in panel if (cost := penalty_of("cross-dimer", found, *binding[end])) > 0]
        worst = max(dimers, default=(0.0, 0.0, None))
        return scale * sums["hairpin"], scale * sums["self-dimer"], scale * cross, scale * worst[0], worst[2], len(dimers), scale * sum((x[0] for x in dimers), 0.0)

    @F.arrow_udf("hairpin_c double, self_dimer_c double, cross_dimer_c double, panel_c double, panel_partner string, panel_count int, panel_burden_c double")
    def cost(*columns: pa.Array) -> pa.Array:
        return by_distinct(costs, COSTS, *columns)

    got = rows.drop("score").where("fwd is not null and rev is not null").withColumn("costs", cost("fwd", "rev", "fwd_dg", "rev_dg", "fwd_denominator", "rev_denominator"))
    got = got.withColumns({x.name: F.col("costs")[x.name] for x in COSTS}).drop("costs")
    got = got.withColumn("structure_c", F.col("hairpin_c") + F.col("self_dimer_c") + F.col("cross_dimer_c") + F.col("panel_c"))
    total = F.col("base_score") - F.col("structure_c")
    return got.withColumn("score", duplex.profiled(total, F.col("base_score"), F.col("length").cast("double"), profile))


PROBE_MODES = ("annotate", "gate", "blend")
#: Degrees taken from an amplicon in which the probe isn't found, in blend mode.
PROBE_MISSING = 12.0


def with_probe_score(rows: DataFrame, name: str, probe: str, max_mm: int = 0, mode: str = "gate", policy: str = "worst", least_margin: float = 0.0, weight: float = 1.0, c: Conditions = Conditions(), most: int = 256) -> DataFrame:
    """rows (KEY, seq, score) with the probe's place, probe_tm, probe_margin and probe_dg, all null where it isn't found.

    gate keeps the rows where the probe is found with least_margin at least;
    blend moves the score by `weight` towards the smaller of it and the probe's
    margin, or takes a fixed cost where it isn't found. worst and best choose
    among the sequences the probe stands for, mean and enumerate average them.
    """
    if mode not in PROBE_MODES or policy not in POLICIES:
        raise ValueError(f"no probe mode or policy: {mode!r}, {policy!r}")
    variants = expansions(normalized(probe), most)
    if policy == "strict" and variants != [normalized(probe)]:
        raise ValueError("the strict policy needs a probe of plain bases")
    site = F.col("probe_site")
    got = with_probe(rows, name, probe, max_mm).withColumn("probe_target", F.when(F.col("probe_strand") == "-", F.reverse(site)).otherwise(duplex.complement(site)))
    terms = ("probe_tm", "probe_margin", "probe_dg")
    if len(variants) == 1:
        got = duplex.imperfect(got.withColumn("probe_variant", F.lit(variants[0])), "probe_variant", "probe_target", "probe_", c)
    else:
        kept = got.columns
        each = got.select(*kept, F.posexplode(F.array(*[F.lit(v) for v in variants])).alias("ord", "probe_variant"))
        each = duplex.imperfect(each, "probe_variant", "probe_target", "probe_", c)
        rest = F.first(F.struct(*[x for x in kept if x not in KEY])).alias("rest")
        if policy in ("mean", "enumerate"):
            chosen = [F.avg(x).alias(x) for x in terms] + [F.lit("").alias("probe_variant")]
        else:
            order = F.struct("probe_margin", "ord") if policy == "worst" else F.struct(-F.col("probe_margin"), "ord")
            chosen = [F.min_by(x, order).alias(x) for x in (*terms, "probe_variant")]
        got = each.groupBy(*KEY).agg(rest, *chosen).select(*KEY, "rest.*", *terms, "probe_variant")
    whole = len(expansions(normalized(probe), most + 1))
    labels = {"probe_iupac_thermo_policy": F.lit(policy), "probe_iupac_expansion_count": F.lit(len(variants)), "probe_iupac_expansion_capped": F.lit(whole > most), "probe_iupac_effective_variant": F.when(F.col("probe_found"), F.col("probe_variant"))}
    got = got.withColumns(labels).select(*rows.columns, "probe_found", "probe_strand", "probe_pos", "probe_mm", "probe_site", *terms, *labels)
    if mode == "gate":
        return got.where(F.col("probe_found") & (F.col("probe_margin") >= least_margin))
    if mode == "blend":
        moved = (1 - weight) * F.col("score") + weight * F.least("score", "probe_margin")
        got = got.withColumn("score", F.when(F.col("probe_found"), moved).otherwise(F.col("score") - PROBE_MISSING))
    return got
