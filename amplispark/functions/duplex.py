"""Primers on imperfect targets: mismatches, terminal mismatches and dangling ends.

Amplicons are many, but their primers and sites repeat: each distinct one of an
Arrow batch is computed once, and a worker remembers the last ones.

A target is written 3' to 5', letter under letter of its primer. The perfect
duplex's melting temperature is lowered by what each mismatch costs and shifted
by the base of the template beside the primer's end.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import thermo
from .batched import by_distinct
from .thermo import Conditions

#: Published free energies (kcal/mol, 37 degrees, 1 M sodium) of matched dimers by the upper strand.
MATCHED = {
    "AA": -1.00, "AT": -0.88, "TA": -0.58, "CA": -1.45, "GT": -1.44, "CT": -1.28, "GA": -1.30, "CG": -2.17,
    "GC": -2.24, "GG": -1.84, "TT": -1.00, "TG": -1.45, "AC": -1.44, "AG": -1.28, "TC": -1.30, "CC": -1.84,
}
#: The same of a matched pair and the mismatch X/Y after it, by the upper base of the pair and XY.
INTERNAL = {
    "A": {"AA": 0.61, "AC": 0.88, "AG": 0.14, "CA": 0.77, "CC": 1.33, "CT": 0.64, "GA": 0.02, "GG": -0.13, "GT": 0.71, "TC": 0.73, "TG": 0.07, "TT": 0.69},
    "C": {"AA": 0.43, "AC": 0.75, "AG": 0.03, "CA": 0.79, "CC": 0.70, "CT": 0.62, "GA": 0.11, "GG": -0.11, "GT": -0.47, "TC": 0.40, "TG": -0.32, "TT": -0.12},
    "G": {"AA": 0.17, "AC": 0.81, "AG": -0.25, "CA": 0.47, "CC": 0.79, "CT": 0.62, "GA": -0.52, "GG": -1.11, "GT": 0.08, "TC": 0.98, "TG": -0.59, "TT": 0.45},
    "T": {"AA": 0.69, "AC": 0.92, "AG": 0.42, "CA": 1.33, "CC": 1.05, "CT": 0.97, "GA": 0.74, "GG": 0.44, "GT": 0.43, "TC": 0.75, "TG": 0.34, "TT": 0.68},
}
#: Cost (kcal/mol) of a mismatch of primer and target base where its neighbours aren't matched pairs.
#: It holds whatever the neighbours are: neighbours only change the cost of a base that isn't known.
PAIR = {
    "GT": 0.60, "TG": 0.60, "AG": 0.85, "GA": 0.85, "CT": 0.85, "TC": 0.85, "AC": 1.10, "CA": 1.10,
    "AA": 1.40, "CC": 1.40, "GG": 1.40, "TT": 1.40,
}
#: Free energies of a dangling base X beside the pair of its own strand's base, for X of A, C, G, T.
DANGLING_5 = {"A": (-0.51, -0.42, -0.62, -0.71), "C": (-0.96, -0.52, -0.72, -0.58), "G": (-0.58, -0.34, -0.56, -0.61), "T": (-0.50, -0.02, 0.48, -0.10)}
DANGLING_3 = {"A": (-0.12, 0.28, -0.01, 0.13), "C": (-0.82, -0.31, -0.01, -0.52), "G": (-0.92, -0.23, -0.44, -0.35), "T": (-0.48, -0.19, -0.50, -0.29)}

PARTNER = {"A": "T", "C": "G", "G": "C", "T": "A"}
#: What a mismatch with an unknown base costs, and how much less among mostly G and C.
UNKNOWN, UNKNOWN_IN_GC = 1.0, 0.05
#: Degrees that any mismatch costs where no denominator is known.
NO_DENOMINATOR_C = 4.0
#: Bases at either end whose mismatches weigh more, the weights, and what the very last base adds in degrees.
END, WEIGHT_5, WEIGHT_3, LAST_5, LAST_3 = 3, 1.5, 2.0, 0.5, 1.5


def triplets() -> dict[str, float]:
    """Cost of a mismatch between matched pairs, by primer triplet and target triplet.

    Both dimers that hold the mismatch (the second read along the other strand)
    against the two matched dimers.
    """
    out = {}
    for a in "ACGT":
        for b in "ACGT":
            for x in "ACGT":
                for y in set("ACGT") - {PARTNER[x]}:
                    dimers = INTERNAL[a][x + y] + INTERNAL[PARTNER[b]][y + x]
                    out[a + x + b + PARTNER[a] + y + PARTNER[b]] = round(dimers - MATCHED[a + x] - MATCHED[x + b], 2)
    return out


@dataclass(frozen=True)
class Overrides:
    """Costs that count before the tables above, by primer triplet and target triplet; N stands for any neighbour, all of a strand's or none.

    Those in degrees count before those in kcal/mol; of either, a key with
    neighbours of both strands before one with the primer's, the target's, none.
    """

    kcal: Mapping[str, float] = field(default_factory=dict)
    degrees: Mapping[str, float] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash((frozenset(self.kcal.items()), frozenset(self.degrees.items())))

    @staticmethod
    def find(table: Mapping[str, float], a: str, b: str) -> float | None:
        bare = lambda x: f"N{x[1:2]}N"
        return next((table[k] for k in (a + b, a + bare(b), bare(a) + b, bare(a) + bare(b)) if k in table), None) if table else None


def dangling(table: dict[str, tuple[float, ...]]) -> dict[str, float]:
    """By dangling base and the target's base beside it."""
    return {x + paired: v for paired, row in table.items() for x, v in zip("ACGT", row, strict=True)}


def lookup(table: dict[str, float], key: Column) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v!r}D" for k, v in sorted(table.items())) + ")")[key]


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


class Mismatch(NamedTuple):
    """One mismatch: its place, whether its triplet and whether its cost are known, its cost in kcal/mol, and in degrees where overrides have it so."""

    i: int
    triplet: bool
    known: bool
    cost: float
    degrees: float | None


_TRIPLETS = triplets()
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
MEMORY = 1 << 16


def mismatch_costs(primer: str | None, target: str | None, before_primer: str = "N", before_target: str = "N", overrides: Overrides = Overrides()) -> list[Mismatch]:
    """One for each mismatch of target under primer; bases before the strands are their neighbours."""
    if primer is None or target is None:
        return []
    top, low, out = before_primer + primer + "N", before_target + target + "N", []
    for i, x in enumerate(primer):
        if x.translate(_COMPLEMENT) == target[i : i + 1]:
            continue
        a, b = top[i : i + 3], low[i : i + 3]
        beside = a[:1] + a[2:3] + b[:1] + b[2:3]
        count = lambda letters: sum(y in letters for y in beside)  # noqa: E731, B023
        degrees = Overrides.find(overrides.degrees, a, b)
        triplet = next((y for y in (degrees, Overrides.find(overrides.kcal, a, b), _TRIPLETS.get(a + b)) if y is not None), None)
        cost = PAIR.get(a[1:2] + b[1:2]) if triplet is None else triplet
        unknown = UNKNOWN - UNKNOWN_IN_GC if count("GC") >= count("AT") + 2 else UNKNOWN
        out.append(Mismatch(i, triplet is not None, cost is not None, unknown if cost is None else cost, degrees))
    return out


def shifted_costs(primer: str, target: str, longer: bool) -> list[Mismatch]:
    """mismatch_costs() of the pairs behind a gap: with the target's first base left out where it is longer, else the primer's.

    Neighbours are those of the whole strands.
    """
    return mismatch_costs(primer, target[1:], "N", target[:1]) if longer else mismatch_costs(primer[1:], target, primer[:1], "N")


def degrees_of(m: Mismatch, denominator: float) -> float:
    return m.degrees if m.degrees is not None else NO_DENOMINATOR_C if denominator <= 0 else m.cost * 1000 / denominator


def in_degrees(cost: Column, denominator: Column | float) -> Column:
    d = denominator if isinstance(denominator, Column) else F.lit(denominator)
    return F.when(d <= 0, NO_DENOMINATOR_C).otherwise(cost * 1000 / d)


def weight(i: int, n: int) -> float:
    return WEIGHT_3 if i >= n - END else WEIGHT_5 if i < END else 1.0


class Duplex(NamedTuple):
    """Terms of a primer on a target."""

    tm: float | None = None
    margin: float | None = None
    dg: float | None = None
    denominator: float | None = None
    mismatches: int | None = None
    penalty: float | None = None
    dangling_dg: float | None = None
    policy: str | None = None


TERMS = "tm double, margin double, dg double, denominator double, mismatches int, penalty double, dangling_dg double, policy string"
FIELDS = [pa.field(n, {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split() for x in TERMS.split(", "))]


@lru_cache(MEMORY)
def duplex_of(p: str | None, t: str | None, beside_3: str | None, beside_5: str | None, c: Conditions, overrides: Overrides = Overrides()) -> Duplex:
    """All null where the primer isn't of plain bases, the target holds other letters than A, C, G, T and N, or lengths differ."""
    if not p or not t or len(p) != len(t) or set(p) - set("ACGT") or set(t) - set("ACGTN"):
        return Duplex()
    n, dh, tm0, bad = len(p), thermo.sums_of(p)[0], thermo.tm_of(p, c), mismatch_costs(p, t, overrides=overrides)
    denominator = abs(dh * 1000 / (tm0 + 273.15))
    penalty = dangling_dg = 0.0
    for m in bad:
        last = LAST_3 if m.i == n - 1 else LAST_5 if m.i == 0 else 0.0
        penalty += max(0.0, degrees_of(m, denominator) * weight(m.i, n) + last)
    for beside, table, at in ((beside_3, DANGLING_5, n - 1), (beside_5, DANGLING_3, 0)):
        if beside and PARTNER[p[at]] == t[at] and t[at] in table and beside in PARTNER:
            dangling_dg += table[t[at]]["ACGT".index(beside)]
    tm = tm0 - penalty - dangling_dg * 1000 / denominator
    at_anneal = dh + (c.anneal_c + 273.15) * denominator / 1000
    policy = "perfect" if not bad else "unknown base" if not all(m.known for m in bad) else "triplet" if any(m.triplet for m in bad) else "pair"
    return Duplex(tm, tm - c.anneal_c, at_anneal + penalty * denominator / 1000 + dangling_dg, denominator, len(bad), penalty, dangling_dg, policy)


def duplexes(rows: DataFrame, ends: list[tuple[str, str, str, str, str]], c: Conditions = Conditions(), overrides: Overrides = Overrides()) -> DataFrame:
    """imperfect() of several (primer, target, prefix, beside_3, beside_5) at once."""

    @F.arrow_udf(TERMS)
    def terms(p: pa.Array, t: pa.Array, beside_3: pa.Array, beside_5: pa.Array) -> pa.Array:
        return by_distinct(lambda *x: duplex_of(*x, c, overrides), FIELDS, p, t, beside_3, beside_5)

    name = lambda x: F.col(x) if x else F.lit("")
    got = rows.withColumns({f"{prefix}duplex": terms(F.col(p), F.col(t), name(b3), name(b5)) for p, t, prefix, b3, b5 in ends})
    found = {f"{prefix}{x.name}": F.col(f"{prefix}duplex")[x.name] for _, _, prefix, _, _ in ends for x in FIELDS}
    return got.withColumns(found).drop(*[f"{prefix}duplex" for _, _, prefix, _, _ in ends])


def imperfect(rows: DataFrame, primer: str, target: str, prefix: str, c: Conditions = Conditions(), beside_3: str = "", beside_5: str = "", overrides: Overrides = Overrides()) -> DataFrame:
    """rows and, under the prefix, tm, margin, dg, denominator, mismatches, penalty, dangling_dg and policy.

    primer and target name columns, as do beside_3 and beside_5, the template's
    bases beyond the primer's ends. All are null where the primer isn't of plain
    bases, the target holds other letters than A, C, G, T and N, or lengths differ.
    """
    return duplexes(rows, [(primer, target, prefix, beside_3, beside_5)], c, overrides)


@lru_cache(MEMORY)
def old_penalty_of(p: str | None, t: str | None, denominator: float = 200.0, overrides: Overrides = Overrides()) -> float:
    if not p or t is None or len(p) != len(t) or set(p) - set("ACGT"):
        return 0.0
    return max(0.0, sum((degrees_of(m, denominator) * weight(m.i, len(p)) for m in mismatch_costs(p, t, overrides=overrides)), 0.0))


def old_penalty(primer: Column, target: Column, denominator: Column | float = 200.0, overrides: Overrides = Overrides()) -> Column:
    """The older model's penalty in degrees without gaps: weighted mismatches, 0 at least; 0 where the primer isn't of plain bases."""

    @F.arrow_udf("p double")
    def of(p: pa.Array, t: pa.Array, d: pa.Array) -> pa.Array:
        return by_distinct(lambda *x: (old_penalty_of(*x, overrides),), [pa.field("p", pa.float64())], p, t, d)

    return of(primer, target, denominator if isinstance(denominator, Column) else F.lit(float(denominator)))["p"]


@dataclass(frozen=True)
class Profile:
    """How an amplicon's score follows from its limiting margin: binding, pcr or gel."""

    kind: str = "binding"
    extension_alpha: float = 0.45
    extension_weight: float = 1.0
    knee: int = 550
    steepness: float = 0.003
    most: float = 10.0
    binding_weight: float = 1.0
    band_weight: float = 15.0

    def __post_init__(self):
        if self.kind not in ("binding", "pcr", "gel"):
            raise ValueError(f"no profile: {self.kind!r}")


#: Length (bp) at which the mass of a band adds nothing.
BAND_BP = 100


def extension_logit(margin: Column, alpha: float) -> Column:
    p = 1 / (1 + F.exp(-alpha * margin))
    return F.when(p <= 1e-9, -20.0).when(p >= 1 - 1e-9, 20.0).otherwise(F.log(p / (1 - p)))


def length_penalty(length: Column, profile: Profile) -> Column:
    steep = profile.steepness if profile.steepness > 0 else 0.003
    return F.when(length <= profile.knee, 0.0).otherwise(profile.most / (1 + F.exp(-steep * (length - profile.knee))))


def profiled_value(score: float, length: float, profile: Profile) -> float:
    """profiled() of one score that is its own margin."""
    if profile.kind == "binding":
        return score
    p = 1 / (1 + math.exp(min(-profile.extension_alpha * score, 700.0)))
    logit = -20.0 if p <= 1e-9 else 20.0 if p >= 1 - 1e-9 else math.log(p / (1 - p))
    steep = profile.steepness if profile.steepness > 0 else 0.003
    out = score * profile.binding_weight + profile.extension_weight * logit - (0.0 if length <= profile.knee else profile.most / (1 + math.exp(-steep * (length - profile.knee))))
    if profile.kind == "gel" and profile.band_weight:
        out += profile.band_weight * math.log(length / BAND_BP) / math.log(2) if length > 0 else 0.0
    return out


def profiled(score: Column, margin: Column, length: Column, profile: Profile) -> Column:
    """score under the profile; margin is the smaller of both primers'."""
    if profile.kind == "binding":
        return score
    out = score * profile.binding_weight + profile.extension_weight * extension_logit(margin, profile.extension_alpha) - length_penalty(length, profile)
    if profile.kind == "gel" and profile.band_weight:
        out = out + F.when(length > 0, profile.band_weight * F.log(length / BAND_BP) / math.log(2)).otherwise(0.0)
    return out
