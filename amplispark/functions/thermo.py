"""Nearest-neighbour melting temperatures as Spark expressions over sums that are taken in Arrow batches."""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import reverse_complement, revcomp
from .batched import laid_end_to_end, sums

#: Unified nearest-neighbour parameters at 1 M sodium, as (kcal/mol, cal/(K mol)) by the upper strand's dimer.
STACKS = {
    "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
    "TT": (-7.9, -22.2), "CC": (-8.0, -19.9), "AC": (-8.4, -22.4), "TG": (-8.5, -22.7), "AG": (-7.8, -21.0), "TC": (-8.2, -22.2),
}
INITIATION, TERMINAL_AT, SYMMETRY = (0.2, -5.7), (2.2, 6.9), (0.0, -1.4)
GAS, MG_DNTP = 1.9872, 3e4


SALT_MODELS = ("monovalent", "owczarzy-lite", "owczarzy08")
UNITS = {"": 1.0, "m": 1.0, "mm": 1e-3, "um": 1e-6, "nm": 1e-9}


def concentration(text: str) -> float:
    """mol/l of 50mM, 250 nM, 3uM, 3µM or a bare number."""
    found = re.fullmatch(r"\s*\+?(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?)\s*([a-zµμ]*)\s*", text.lower())
    unit = found[2].replace("µ", "u").replace("μ", "u") if found else None
    if unit not in UNITS:
        raise ValueError(f"no concentration: {text!r}")
    return float(found[1]) * UNITS[unit]


def salt_model(text: str) -> str:
    """The name of a salt model; monovalent if it is empty."""
    name = text.strip().lower() or SALT_MODELS[0]
    if name not in SALT_MODELS:
        raise ValueError(f"no salt model: {text!r}")
    return name


@dataclass(frozen=True)
class Conditions:
    anneal_c: float = 60.0
    na: float = 0.05
    mg: float = 0.003
    dntp: float = 0.0
    primer: float = 2.5e-7
    model: str = "monovalent"

    def __post_init__(self):
        if self.model not in SALT_MODELS:
            raise ValueError(f"no salt model: {self.model!r}")

    def with_defaults(self) -> Conditions:
        """The usual values where temperature, sodium or primer are 0; no magnesium is a condition like any other."""
        usual = Conditions()
        return replace(self, **{k: getattr(usual, k) for k in ("anneal_c", "na", "primer") if not getattr(self, k)})

    def free_mg(self) -> float:
        """Magnesium left by the dNTPs."""
        if self.mg <= 0 or self.dntp <= 0:
            return max(self.mg, 0.0)
        b = MG_DNTP * (self.dntp - self.mg) + 1
        return max(0.0, (math.sqrt(b * b + 4 * MG_DNTP * self.mg) - b) / (2 * MG_DNTP))

    def sodium(self) -> float:
        extra = 3.8 * math.sqrt(self.free_mg()) if self.model == "owczarzy-lite" and self.mg > 0 else 0.0
        return self.na + extra


def self_complementary(seq: Column) -> Column:
    return seq == revcomp(seq)


#: STACKS in tenths by the codes of both bases, so that their sums are exact.
TENTHS = np.array([[[round(10 * STACKS["ACGT"[x] + "ACGT"[y]][k]) if x < 4 and y < 4 else 0 for y in range(6)] for x in range(6)] for k in (0, 1)], np.int64)
NEIGHBOURS = "h double, s double, own boolean, gc double"


def _neighbours(seqs: pa.Array) -> pa.Array:
    """struct(h, s, own, gc): enthalpy, entropy, whether the sequence is its own reverse complement, and its share of G and C; h and s are null unless it is of plain bases."""
    seqs = seqs.combine_chunks() if isinstance(seqs, pa.ChunkedArray) else seqs
    code, begin, size = laid_end_to_end(seqs)
    short = np.flatnonzero(size < 2)
    plain = sums(code > 3, begin, size) == 0
    plain[short] = True
    place = np.arange(len(code)) - np.repeat(begin, size)
    mirror = np.repeat(begin + size - 1, size) - place
    own = (sums(code + code[mirror] == 3, begin, size) == size) & plain
    texts = seqs.take(pa.array(short)).to_pylist()
    own[short] = [x is not None and x == reverse_complement(x) for x in texts]
    # a letter at an end counts twice where it is the only one
    first, last = (np.where(size > 0, np.append(code, 5)[at], 5) for at in (begin, np.maximum(begin + size - 1, 0)))
    ends = ((first == 0) | (first == 3)).astype(np.int64) + ((last == 0) | (last == 3))
    found = []
    for k in (0, 1):
        stack = np.append(TENTHS[k][code[:-1], code[1:]], 0) if len(code) else code
        tenths = sums(stack, begin, np.maximum(size - 1, 0)) + round(10 * INITIATION[k]) + round(10 * TERMINAL_AT[k]) * ends + round(10 * SYMMETRY[k]) * own
        found.append(tenths / 10)
    null = ~plain | seqs.is_null().to_numpy(zero_copy_only=False)
    gc = sums((code == 1) | (code == 2), begin, size) / np.maximum(size, 1)
    return pa.StructArray.from_arrays([pa.array(found[0], mask=null), pa.array(found[1], mask=null), pa.array(own, mask=seqs.is_null().to_numpy(zero_copy_only=False)), pa.array(gc)], names=["h", "s", "own", "gc"])


def neighbours(seq: Column) -> Column:
    """struct(h, s, own) of a sequence: see _neighbours."""

    @F.arrow_udf(NEIGHBOURS)
    def of(seqs: pa.Array) -> pa.Array:
        return _neighbours(seqs)

    return of(seq)


def sums_of(seq: str) -> tuple[float, float]:
    """(enthalpy, entropy) of one sequence of plain bases."""
    own, at = seq == reverse_complement(seq), lambda k, e: TERMINAL_AT[k] if e in ("A", "T") else 0.0
    h, s = (INITIATION[k] + reduce(operator.add, (STACKS[seq[i : i + 2]][k] for i in range(len(seq) - 1)), 0.0) + at(k, seq[:1]) + at(k, seq[-1:]) + (SYMMETRY[k] if own else 0.0) for k in (0, 1))
    return h, s


def tm_of(seq: str, c: Conditions) -> float:
    """tm() of one sequence of plain bases."""
    dh, ds = sums_of(seq)
    conc = GAS * math.log(c.primer if seq == reverse_complement(seq) else c.primer / 4)
    if c.model != "owczarzy08":
        return dh * 1000 / (ds + 0.368 * math.log(max(c.sodium(), 1e-9)) * (len(seq) - 1) + conc) - 273.15
    shift = magnesium_shift(sum(x in "GC" for x in seq) / len(seq), 0.5 / (len(seq) - 1) if len(seq) > 1 else 0.0, c)
    return 1 / (1 / (dh * 1000 / (ds + conc)) + shift) - 273.15


def enthalpy(seq: Column) -> Column:
    return neighbours(seq)["h"]


def entropy(seq: Column) -> Column:
    return neighbours(seq)["s"]


def log_concentration(seq: Column, c: Conditions) -> Column:
    return F.when(neighbours(seq)["own"], GAS * math.log(c.primer)).otherwise(GAS * math.log(c.primer / 4))


def magnesium_shift(gc: Column | float, per_stack: Column | float, c: Conditions) -> Column | float:
    """What mixed salts add to 1/Tm, by GC fraction and half the reciprocal of the number of stacks."""
    mg, na = c.free_mg(), max(c.na, 1e-9)
    ratio = math.sqrt(mg) / na
    if mg <= 0 or ratio < 0.22:
        return (4.29 * gc - 3.95) * 1e-5 * math.log(na) + 9.4e-6 * math.log(na) ** 2
    a, d, g, x, y = 3.92, 1.42, 8.31, math.log(mg), math.log(na)
    if ratio < 6:
        a *= 0.843 - 0.352 * math.sqrt(na) * y
        d *= 1.279 - 4.03e-3 * y - 8.03e-3 * y * y
        g *= 0.486 - 0.258 * y + 5.25e-3 * y**3
    return (a - 0.911 * x + gc * (6.26 + d * x) + per_stack * (-48.2 + 52.5 * x + g * x * x)) * 1e-5


def tm(seq: Column, c: Conditions = Conditions()) -> Column:
    """Melting temperature in degrees C of a primer of plain bases with its perfect complement."""
    dh, ds, conc = enthalpy(seq), entropy(seq), log_concentration(seq, c)
    na = max(c.sodium(), 1e-9)
    if c.model != "owczarzy08":
        return dh * 1000 / (ds + 0.368 * math.log(na) * (F.length(seq) - 1) + conc) - 273.15
    per_stack = F.when(F.length(seq) > 1, 0.5 / (F.length(seq) - 1)).otherwise(0.0)
    shift = magnesium_shift(neighbours(seq)["gc"], per_stack, c)
    return 1 / (1 / (dh * 1000 / (ds + conc)) + shift) - 273.15


def delta_g(seq: Column, c: Conditions = Conditions()) -> Column:
    """Free energy in kcal/mol at the annealing temperature."""
    denominator = enthalpy(seq) * 1000 / (tm(seq, c) + 273.15)
    return enthalpy(seq) - (c.anneal_c + 273.15) * denominator / 1000
