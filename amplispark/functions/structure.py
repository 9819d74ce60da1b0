"""Hairpins and dimers of primers: stems, stems with one gap, and the ensemble of them.

Both strands are laid side by side and a table of run lengths (matched pairs from
each place on) gives every stem; a stem with a gap is two runs with a bulge or an
internal loop between. Each distinct primer or pair of an Arrow batch is computed
once, and all those of equal lengths as one array: structures_of() does that, and
structure() is the same one candidate after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import thermo
from .batched import CODE, distinct_rows
from .duplex import PARTNER
from .thermo import GAS, Conditions

#: Shortest stem, hairpin loop and part of a gapped stem; longest gap on a strand.
STEM, LOOP, PART, GAP = 4, 3, 2, 2
#: Gapped stems that are looked at at once, and cells of a table of runs.
STEMS_AT_ONCE, CELLS_AT_ONCE = 1 << 20, 1 << 20
#: Strands whose lengths differ by less stand in one array.
WIDTH = 24
#: kcal/mol of loops and gaps (first, by logarithm of length, by asymmetry) and of unpaired bases in a gap.
HAIRPIN_LOOP, BULGE, INTERNAL_LOOP, ASYMMETRY = (3.0, 0.2), (0.8, 0.45), (1.4, 0.35), 0.25
UNPAIRED, UNPAIRED_LEAST = {"A": -0.05, "C": -0.08, "G": -0.08, "T": -0.05}, -0.30
#: kcal/mol of a pair in the folding ensemble of a single strand.
FOLD_PAIR = {"A": -1.1, "C": -2.2, "G": -2.2, "T": -1.1}
#: Window (kcal/mol) within which a structure competes with binding, and the most degrees it costs.
WINDOWS, MOST_PENALTY = (1.0, 2.0, 3.0), 30.0

KINDS, MODES = ("hairpin", "self-dimer", "cross-dimer"), ("stem", "gapped", "ensemble")
SCHEMA = "dg double, tm double, margin double, stem int, loop int, a_start int, a_end int, b_start int, b_end int, anchored boolean, both_anchored boolean, bulges int, internal_loops int, candidates int, weight double, fold_pairs double, fold_dg double"


@dataclass(frozen=True)
class Structure:
    dg: float
    tm: float
    margin: float
    stem: int
    loop: int
    a_start: int
    a_end: int
    b_start: int
    b_end: int
    anchored: bool
    both_anchored: bool
    bulges: int = 0
    internal_loops: int = 0
    candidates: int = 0
    weight: float = 0.0
    fold_pairs: float = 0.0
    fold_dg: float = 0.0


@lru_cache(100_000)
def _terms(top: str, x: int, c: Conditions) -> tuple[float, float]:
    """(enthalpy, entropy with salt) of a stem and its perfect complement."""
    h, s = (thermo.INITIATION[k] + sum(thermo.STACKS[top[i : i + 2]][k] for i in range(len(top) - 1)) + sum(thermo.TERMINAL_AT[k] for e in (top[0], top[-1]) if e in "AT") for k in (0, 1))
    if top == "".join(PARTNER[b] for b in reversed(top)):
        h, s = h + thermo.SYMMETRY[0], s + thermo.SYMMETRY[1]
    if c.model != "owczarzy08":
        return h, s + 0.368 * (len(top) - 1) * math.log(max(c.sodium(), 1e-9))
    conc = GAS * math.log(c.primer / x)
    gc = sum(b in "GC" for b in top) / len(top)
    per_stack = 0.5 / (len(top) - 1) if len(top) > 1 else 0.0
    kelvin = 1 / (1 / (h * 1000 / (s + conc)) + thermo.magnesium_shift(gc, per_stack, c))
    return h, h * 1000 / kelvin - conc


def _runs(top: str, low: str) -> list[list[int]]:
    """Number of matched pairs in a row from each place of both strands on."""
    out = [[0] * (len(low) + 1) for _ in range(len(top) + 1)]
    for i in range(len(top) - 1, -1, -1):
        for j in range(len(low) - 1, -1, -1):
            if PARTNER[top[i]] == low[j]:
                out[i][j] = out[i + 1][j + 1] + 1
    return out


class _Strands:
    """Candidates of one kind for one primer or pair."""

    def __init__(self, kind: str, a: str, b: str, c: Conditions):
        self.kind, self.a, self.b, self.c = kind, a, b, c
        self.low = b[::-1]
        self.runs = _runs(a, self.low)
        self.x = 1 if kind == "self-dimer" else 4
        h, s = _terms("GCGC", 4, c)
        self.per_degree = abs(s + GAS * math.log(c.primer / 4)) or 200.0

    def _made(self, i: int, j: int, parts: tuple[int, ...], gap: tuple[int, int], loop: int) -> Structure:
        """The stem that begins at place i of the upper and j of the lower strand."""
        hairpin, first, stem = self.kind == "hairpin", parts[0], sum(parts)
        top = self.a[i : i + first] + self.a[i + first + gap[0] : i + gap[0] + stem]
        h, s = _terms(top, self.x, self.c)
        conc = 0.0 if hairpin else GAS * math.log(self.c.primer / self.x)
        h_loop = h + (HAIRPIN_LOOP[0] + HAIRPIN_LOOP[1] * math.log(loop) if hairpin else 0.0)
        dg = h_loop - (self.c.anneal_c + 273.15) * (s + conc) / 1000
        tm = h_loop * 1000 / (s + conc) - 273.15
        if any(gap):
            total = math.log(sum(gap) + 1)
            cost = INTERNAL_LOOP[0] + INTERNAL_LOOP[1] * total + ASYMMETRY * abs(gap[0] - gap[1]) if all(gap) else BULGE[0] + BULGE[1] * total
            loose = self.a[i + first : i + first + gap[0]] + self.low[j + first : j + first + gap[1]]
            cost += max(UNPAIRED_LEAST, sum(UNPAIRED[x] for x in loose))
            dg, tm = dg + cost, tm - cost * 1000 / self.per_degree
        a_end, b_low = i + stem + gap[0], j + stem + gap[1]
        b_start, b_end = len(self.b) - b_low, len(self.b) - j
        ends = a_end == len(self.a), b_end == len(self.b)
        return Structure(dg, tm, tm - self.c.anneal_c, stem, loop, i, a_end, b_start, b_end, any(ends), all(ends) and not hairpin, int(any(gap) and not all(gap)), int(all(gap)))

    def stems(self, whole: bool) -> Iterator[Structure]:
        """Stems without a gap; whole gives a dimer's longest from each place only."""
        n, m = len(self.a), len(self.low)
        if self.kind == "hairpin":
            for i in range(n - 2 * STEM - LOOP + 1):
                for right in range(i + STEM + LOOP, n - STEM + 1):
                    for stem in range(STEM, min(n - right, right - i - LOOP) + 1):
                        j = n - right - stem
                        if self.runs[i][j] >= stem:
                            yield self._made(i, j, (stem,), (0, 0), right - i - stem)
            return
        for i in range(n - STEM + 1):
            for j in range(m - STEM + 1):
                run = self.runs[i][j]
                for stem in range(run if whole else STEM, run + 1) if run >= STEM else ():
                    yield self._made(i, j, (stem,), (0, 0), 0)

    def _gapped_at(self, i: int, j: int, n: int, m: int) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
        """(parts, gap) of gapped stems from one place, within n upper and m lower letters."""
        for first in range(PART, min(self.runs[i][j], m - j) + 1):
            for up in range(GAP + 1):
                for down in range(GAP + 1):
                    k, q = i + first + up, j + first + down
                    if (up or down) and k < n and q < m:
                        for second in range(max(PART, STEM - first), min(self.runs[k][q], m - q) + 1):
                            yield (first, second), (up, down)

    def gapped(self) -> Iterator[Structure]:
        """Stems with one gap; a hairpin's right arm begins at the primer's last base."""
        n = len(self.a)
        if self.kind == "hairpin":
            if n < 2 * STEM + LOOP + 1:
                return
            for i in range(n):
                for right in range(i + STEM + LOOP, n):
                    for parts, gap in self._gapped_at(i, 0, n, n - right):
                        loop = right - (i + sum(parts) + gap[0])
                        if loop >= LOOP:
                            yield self._made(i, 0, parts, gap, loop)
            return
        for i in range(n):
            for j in range(len(self.low)):
                for parts, gap in self._gapped_at(i, j, n, len(self.low)):
                    yield self._made(i, j, parts, gap, 0)

    def all(self) -> Iterator[Structure]:
        if min(len(self.a), len(self.b)) >= (2 * STEM + LOOP if self.kind == "hairpin" else STEM):
            yield from self.stems(False)
            yield from self.gapped()


def _better(x: Structure, y: Structure | None) -> bool:
    """Lower energy; where equal, more 3' ends within, then a longer stem."""
    if y is None or abs(x.dg - y.dg) > 1e-9:
        return y is None or x.dg < y.dg
    return (x.both_anchored, x.anchored, x.stem) > (y.both_anchored, y.anchored, y.stem)


def _best(found: Iterator[Structure]) -> Structure | None:
    best = None
    for x in found:
        if _better(x, best):
            best = x
    return best


def folding(seq: str, c: Conditions) -> tuple[float, float, float]:
    """(partition function, expected pairs, energy) of all nested pairings of one strand."""
    n, rt = len(seq), GAS / 1000 * (c.anneal_c + 273.15)
    weight = {b: math.exp(-g / rt) for b, g in FOLD_PAIR.items()}
    # z[i][j] and mass[i][j] are of seq[i:j]; mass is the sum over pairings of weight times pairs
    z = [[1.0] * (n + 1) for _ in range(n + 2)]
    mass = [[0.0] * (n + 1) for _ in range(n + 2)]
    for span in range(2, n + 1):
        for i in range(n - span + 1):
            j = i + span - 1
            total, pairs = z[i][j], mass[i][j]
            for k in range(i, j - LOOP):
                if PARTNER[seq[k]] == seq[j]:
                    left, inside, w = z[i][k], z[k + 1][j], weight[seq[j]]
                    total += w * left * inside
                    pairs += w * (left * inside + mass[i][k] * inside + left * mass[k + 1][j])
            z[i][j + 1], mass[i][j + 1] = total, pairs
    return z[0][n], mass[0][n] / z[0][n], -rt * math.log(z[0][n])


def _ensemble(found: Iterator[Structure], c: Conditions) -> Structure | None:
    """The best candidate with the free energy of all."""
    some = list(found)
    best = _best(iter(some))
    if best is None:
        return None
    rt, least = GAS / 1000 * (c.anneal_c + 273.15), min(x.dg for x in some)
    place = lambda x: (x.dg, x.a_start, x.a_end, x.b_start, x.b_end, x.stem, x.bulges + x.internal_loops)
    weights = [math.exp((least - x.dg) / rt) for x in some]
    share = sum(w for w, x in zip(weights, some, strict=True) if place(x) == place(best)) / sum(weights)
    return replace(best, dg=least - rt * math.log(sum(weights)), margin=best.tm - c.anneal_c, candidates=len(some), weight=share)


def structure(kind: str, mode: str, a: str | None, b: str | None = None, c: Conditions = Conditions()) -> Structure | None:
    """The strongest structure, or None if there is none or a primer isn't of plain bases."""
    if kind not in KINDS or mode not in MODES:
        raise ValueError(f"no structure: {kind!r}, {mode!r}")
    b = b if kind == "cross-dimer" else a
    if not a or not b or set(a + b) - set("ACGT"):
        return None
    s = _Strands(kind, a, b, c)
    if mode != "ensemble":
        best = _best(s.stems(kind != "hairpin"))
        again = _best(s.gapped()) if mode == "gapped" else None
        return again if again and _better(again, best) else best
    best = _ensemble(s.all(), c)
    if best and kind == "hairpin":
        z, pairs, dg = folding(a, c)
        if z > 1:
            best = replace(best, fold_pairs=pairs, fold_dg=dg, dg=min(best.dg, dg))
    return best


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the counted things, number within it) for each of all."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


#: Sums of both energies are taken as one number: enthalpy in tenths, and entropy in tenths moved by so many bits.
MOVED = 32
_BOTH = thermo.TENTHS[0] + (thermo.TENTHS[1] << MOVED)
_INITIATION, _TERMINAL_AT, _SYMMETRY = (round(10 * x[0]) + (round(10 * x[1]) << MOVED) for x in (thermo.INITIATION, thermo.TERMINAL_AT, thermo.SYMMETRY))
#: Code of what is behind a strand's end; no letter pairs with it.
BEHIND = 100


class _Batch:
    """Candidates of one kind for rows of codes, BEHIND after each strand's end; n and m are the strands' lengths."""

    def __init__(self, kind: str, a: np.ndarray, n: np.ndarray, low: np.ndarray, m: np.ndarray, c: Conditions):
        self.kind, self.a, self.low, self.c, self.n_of, self.m_of = kind, a, low, c, n, m
        self.n, self.m = a.shape[1], low.shape[1]
        self.x = 1 if kind == "self-dimer" else 4
        h, s = _terms("GCGC", 4, c)
        self.per_degree = abs(s + GAS * math.log(c.primer / 4)) or 200.0
        # by places of both strands and then row, so that all rows are compared as one stretch of memory
        self.runs = np.zeros((self.n + 1, self.m + 1, len(a)), np.uint8 if min(self.n, self.m) < 256 else np.int32)
        upper, lower = np.ascontiguousarray(a.T), np.ascontiguousarray(self.low.T)
        for i in range(self.n - 1, -1, -1):
            self.runs[i, :-1] = (self.runs[i + 1, 1:] + 1) * (upper[i] + lower == 3)
        letter = np.minimum(a, 5)
        prefix = lambda x: np.ascontiguousarray(np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(x, 1)], 1))
        self.stacks = prefix(_BOTH[letter[:, :-1], letter[:, 1:]])
        free = np.array([round(100 * UNPAIRED[x]) for x in "ACGT"] + [0, 0])
        self.free = prefix(free[letter]), prefix(free[np.minimum(self.low, 5)])

    def stems(self, whole: bool) -> tuple[np.ndarray, ...]:
        """(row, i, j, first, second, up, down, loop) of stems without a gap, as _Strands.stems() has them."""
        i, j, row = self._where(self.runs >= STEM)
        most = self.runs[i, j, row].astype(np.int64)
        if self.kind == "hairpin":
            most = np.minimum(most, (self.n_of[row] - i - j - LOOP) // 2)
        which, k = _spread((most >= STEM).astype(np.int64) if whole else np.maximum(most - STEM + 1, 0))
        row, i, j = row[which], i[which], j[which]
        stem = most[which] if whole else STEM + k
        none = np.zeros_like(stem)
        return row, i, j, stem, none, none, none, self.n_of[row] - i - j - 2 * stem if self.kind == "hairpin" else none

    @staticmethod
    def _where(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, row = np.divmod(np.flatnonzero(found), found.shape[2])
        return *np.divmod(rest, found.shape[1]), row

    def _gapped_dimers(self) -> tuple[np.ndarray, ...]:
        """Gapped stems of two strands: runs of one part and of the other are laid over each other, moved by the first part and the gap."""
        second_at, out = self.runs >= PART, []
        gaps = [(u, d) for u in range(GAP + 1) for d in range(GAP + 1) if u or d]

        def add(row, i, j, first, up: int, down: int) -> None:
            most = self.runs[i + first + up, j + first + down, row].astype(np.int64)
            least = np.maximum(PART, STEM - first)
            each, second = _spread(np.maximum(most - least + 1, 0))
            same = lambda x: np.full(len(each), x)
            out.append((row[each], i[each], j[each], first[each], second + least[each], same(up), same(down), same(0)))

        for first in range(PART, STEM):
            first_at = self.runs >= first
            for up, down in gaps:
                s, t = first + up, first + down
                if s < self.n and t < self.m:
                    i, j, row = self._where(first_at[: self.n - s, : self.m - t] & second_at[s : self.n, t : self.m])
                    add(row, i, j, np.full(len(row), first), up, down)
        i, j, row = self._where(self.runs >= STEM)  # few begin with a longer part
        which, first = _spread(self.runs[i, j, row].astype(np.int64) - STEM + 1)
        i, j, row, first = i[which], j[which], row[which], first + STEM
        for up, down in gaps:
            ok = np.flatnonzero((i + first + up < self.n) & (j + first + down < self.m))
            add(row[ok], i[ok], j[ok], first[ok], up, down)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 8

    def gapped(self) -> tuple[np.ndarray, ...]:
        """The same of stems with one gap, as _Strands.gapped() has them."""
        if self.kind != "hairpin":
            return self._gapped_dimers()
        if self.n < 2 * STEM + LOOP + 1:
            return (np.zeros(0, np.int64),) * 8
        i, _, row = self._where(self.runs[:, :1] >= PART)
        long = self.n_of[row] >= 2 * STEM + LOOP + 1
        which, k = _spread(np.maximum(self.n_of[row] - i - STEM - LOOP, 0) * long)  # for each begin of the right arm
        row, i = row[which], i[which]
        m = self.n_of[row] - (i + STEM + LOOP + k)
        run = np.minimum(self.runs[i, 0, row], m)
        which, first = _spread(np.maximum(run - PART + 1, 0))
        first = first + PART
        gaps = np.array([(u, d) for u in range(GAP + 1) for d in range(GAP + 1) if u or d])
        which, first, gap = np.repeat(which, len(gaps)), np.repeat(first, len(gaps)), np.tile(np.arange(len(gaps)), len(which))
        up, down = gaps[gap, 0], gaps[gap, 1]
        k, q, m = i[which] + first + up, first + down, m[which]
        ok = np.flatnonzero((k < self.n) & (q < m))
        which, first, up, down, k, q, m = (x[ok] for x in (which, first, up, down, k, q, m))
        most = np.minimum(self.runs[k, q, row[which]], m - q)
        least = np.maximum(PART, STEM - first)
        each, second = _spread(np.maximum(most - least + 1, 0))
        second = second + least[each]
        which, first, up, down, m = which[each], first[each], up[each], down[each], m[each]
        loop = self.n_of[row[which]] - m - (i[which] + first + second + up)
        return tuple(x[loop >= LOOP] for x in (row[which], i[which], np.zeros_like(loop), first, second, up, down, loop))

    def _order(self, found: tuple[np.ndarray, ...]) -> np.ndarray:
        """By row, and in it as _Strands.all() has them: stems, then gapped ones, each by place."""
        row, i, j, first, second, up, down, loop = found
        place = i + first + second + up + loop if self.kind == "hairpin" else j
        key = row * 2 + (second > 0)
        for x, size in ((i, self.n + 1), (place, max(self.n, self.m) + 1), (first, self.n + 1), (up * (GAP + 1) + down, (GAP + 1) ** 2), (second, self.n + 1)):
            key = key * size + x
        return np.argsort(key)

    def _own(self, row: np.ndarray, i: np.ndarray, first: np.ndarray, up: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Whether the upper letters of each stem are their own reverse complement."""
        out = np.zeros(len(row), bool)
        left = np.flatnonzero(stem % 2 == 0)
        t = 0
        while len(left):
            last = stem[left] - 1 - t
            at = lambda k: self.a[row[left], i[left] + k + np.where(k >= first[left], up[left], 0)]  # noqa: E731, B023
            left = left[at(np.full(len(left), t)) + at(last) == 3]
            t += 1
            done = stem[left] == 2 * t
            out[left[done]] = True
            left = left[~done]
        return out

    def made(self, found: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
        """Energies and places of stems."""
        row, i, j, first, second, up, down, loop = found
        c, stem, hairpin = self.c, first + second, self.kind == "hairpin"
        two, k = second > 0, i + first
        end, split = k + up + second - 1, k + up
        letter = lambda at: self.a.ravel()[row * self.n + at]
        prefix = lambda table, at: table.ravel()[row * table.shape[1] + at]
        e0, e1 = letter(i), letter(end)
        both = prefix(self.stacks, k - 1) - prefix(self.stacks, i) + _INITIATION
        both += _TERMINAL_AT * (((e0 == 0) | (e0 == 3)).astype(np.int64) + ((e1 == 0) | (e1 == 3)))
        both += _SYMMETRY * self._own(row, i, first, up, stem)
        at = np.flatnonzero(two)
        r, x, y = row[at], split[at], end[at]
        flat = self.stacks.ravel()
        both[at] += _BOTH[self.a.ravel()[r * self.n + k[at] - 1], self.a.ravel()[r * self.n + x]] + flat[r * self.stacks.shape[1] + y] - flat[r * self.stacks.shape[1] + x]
        low = both & ((1 << MOVED) - 1)
        low -= (low >> (MOVED - 1)) << MOVED
        h, s = low / 10, ((both - low) >> MOVED) / 10
        conc = GAS * math.log(c.primer / self.x)
        if c.model != "owczarzy08":
            s = s + 0.368 * (stem - 1) * math.log(max(c.sodium(), 1e-9))
        else:
            strong = np.concatenate([np.zeros((len(self.a), 1), np.int64), np.cumsum((self.a == 1) | (self.a == 2), 1)], 1)
            gc = (strong[row, k] - strong[row, i] + np.where(two, strong[row, end + 1] - strong[row, split], 0)) / stem
            kelvin = 1 / (1 / (h * 1000 / (s + conc)) + thermo.magnesium_shift(gc, 0.5 / (stem - 1), c))
            s = h * 1000 / kelvin - conc
        conc = 0.0 if hairpin else conc
        h = h + (HAIRPIN_LOOP[0] + HAIRPIN_LOOP[1] * np.log(np.maximum(loop, 1))) if hairpin else h
        s = s + conc
        dg, tm = h - (c.anneal_c + 273.15) * s / 1000, h * 1000 / s - 273.15
        costs = np.zeros((GAP + 1, GAP + 1))
        for u in range(GAP + 1):
            for d in range(GAP + 1):
                if u or d:
                    total = math.log(u + d + 1)
                    costs[u, d] = INTERNAL_LOOP[0] + INTERNAL_LOOP[1] * total + ASYMMETRY * abs(u - d) if u and d else BULGE[0] + BULGE[1] * total
        q = j + first
        loose = (prefix(self.free[0], split) - prefix(self.free[0], k) + prefix(self.free[1], q + down) - prefix(self.free[1], q)) / 100
        cost = np.where(two, costs.ravel()[up * (GAP + 1) + down] + np.maximum(UNPAIRED_LEAST, loose), 0.0)
        a_end, b_end = i + stem + up, self.m_of[row] - j
        ends = a_end == self.n_of[row], j == 0
        inner = (up > 0) & (down > 0)
        return {
            "row": row, "dg": dg + cost, "tm": tm - cost * 1000 / self.per_degree, "stem": stem, "loop": loop, "a_start": i, "a_end": a_end, "b_start": b_end - stem - down, "b_end": b_end,
            "anchored": ends[0] | ends[1], "both_anchored": ends[0] & ends[1] & (not hairpin), "bulges": (two & ~inner).astype(np.int64), "internal_loops": inner.astype(np.int64),
        }

    def _mirrored(self, found: tuple[np.ndarray, ...]) -> np.ndarray:
        """Of a primer with itself each stem also is one read from the other strand, of equal energy: how often each counts, 0 for the later of both."""
        row, i, j, first, second, up, down, _ = found
        n, stem, size = self.n_of[row], first + second, self.n + 1
        code = lambda i, j, first, up, down: (((i * size + j) * size + first) * (GAP + 1) + up) * (GAP + 1) + down
        here, there = code(i, j, first, up, down), code(n - j - stem - down, n - i - stem - up, np.where(second > 0, second, first), down, up)
        return np.where(here < there, 2, (here == there).astype(np.int64))

    def best(self, mode: str) -> dict[str, np.ndarray]:
        """Of each row that has a structure, its strongest; in an ensemble with the energy of all."""
        every, least_size = mode == "ensemble", 2 * STEM + LOOP if self.kind == "hairpin" else STEM
        each = [self.stems(self.kind != "hairpin" and not every)] + ([self.gapped()] if every or mode == "gapped" else [])
        found = tuple(np.concatenate(x) for x in zip(*each, strict=True))
        if every and self.kind == "hairpin":
            some = self.n_of[found[0]] >= least_size
            found = tuple(x[some] for x in found)
        times = np.ones(len(found[0]), np.int64)
        if every and self.kind == "self-dimer":
            times = self._mirrored(found)
            some = np.flatnonzero(times)
            found, times = tuple(x[some] for x in found), times[some]
        order = self._order(found)
        times, got = times[order], self.made(tuple(x[order] for x in found))
        row, dg = got["row"], got["dg"]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(starts):
            return {k: v[:0] for k, v in got.items()} | {"candidates": row[:0], "weight": dg[:0]}
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))
        least = np.minimum.reduceat(dg, starts)
        near = np.flatnonzero(dg <= least[of] + 1e-9)
        key = ((got["both_anchored"][near] * 2 + got["anchored"][near]) << 32) + got["stem"][near]
        near = near[np.lexsort((near, -key, of[near]))]
        first = near[np.flatnonzero(np.diff(of[near], prepend=-1))]
        out = {k: v[first] for k, v in got.items()} | {"candidates": np.zeros(len(starts), np.int64), "weight": np.zeros(len(starts))}
        if every:
            rt = GAS / 1000 * (self.c.anneal_c + 273.15)
            weights = np.exp((least[of] - dg) / rt)
            total = np.add.reduceat(weights * times, starts)
            same = np.flatnonzero(dg == dg[first][of])
            for x in ("a_start", "a_end", "b_start", "b_end", "stem"):
                same = same[got[x][same] == out[x][of[same]]]
            same = same[got["bulges"][same] + got["internal_loops"][same] == (out["bulges"] + out["internal_loops"])[of[same]]]
            own = (got["a_start"][same] == got["b_start"][same]) & (got["a_end"][same] == got["b_end"][same])  # read from the other strand it is at the same place
            share = np.bincount(of[same], weights[same] * np.where(own, times[same], 1), len(starts))
            out |= {"dg": least - rt * np.log(total), "candidates": np.add.reduceat(times, starts), "weight": share / total}
        return out


def _folded(code: np.ndarray, c: Conditions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """folding() of rows of codes of one length: tables by span and begin, all rows at once."""
    strands = np.ascontiguousarray(code.T)
    n, rt = len(strands), GAS / 1000 * (c.anneal_c + 273.15)
    weight = np.array([math.exp(-FOLD_PAIR[b] / rt) for b in "ACGT"] + [0.0])[np.minimum(strands, 4)]
    pair = {o: np.where(strands[: n - o] + strands[o:] == 3, weight[o:], 0.0) for o in range(LOOP + 1, n)}
    z = [np.ones((n + 1 - s, strands.shape[1])) for s in range(min(n, 1) + 1)]
    mass = [np.zeros_like(x) for x in z]
    for s in range(2, n + 1):
        many = n - s + 1
        total, pairs = z[s - 1][:many].copy(), mass[s - 1][:many].copy()
        for d in range(s - 1 - LOOP):
            w, inside = pair[s - 1 - d][d : d + many], z[s - 2 - d][d + 1 : d + 1 + many]
            left = z[d][:many]
            term = w * left * inside
            total += term
            pairs += term + w * (mass[d][:many] * inside + left * mass[s - 2 - d][d + 1 : d + 1 + many])
        z.append(total)
        mass.append(pairs)
    return z[n][0], mass[n][0] / z[n][0], -rt * np.log(z[n][0])


def structures_of(kind: str, mode: str, pairs: list[tuple[str | None, str | None]], c: Conditions = Conditions()) -> dict[str, np.ndarray]:
    """structure() of many: FIELDS by name, and `found`, false where there is none."""
    if kind not in KINDS or mode not in MODES:
        raise ValueError(f"no structure: {kind!r}, {mode!r}")
    out = {f: np.zeros(len(pairs), bool if t == "boolean" else np.int64 if t == "int" else float) for f, t in FIELDS} | {"found": np.zeros(len(pairs), bool)}
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(pairs):
        b = b if kind == "cross-dimer" else a
        if a and b and not a.strip("ACGT") and not b.strip("ACGT"):  # strands of some 20 lengths stand in one array
            groups.setdefault((-(-len(a) // WIDTH), -(-len(b) // WIDTH)), []).append(k)
    for rows in groups.values():
        upper = [pairs[k][0] for k in rows]
        lower = [x[::-1] for x in ((pairs[k][1] for k in rows) if kind == "cross-dimer" else upper)]
        (a, n), (low, m) = _padded(upper), _padded(lower)
        for part in _shares(kind, a, low):
            got = _Batch(kind, a[part], n[part], low[part], m[part], c).best(mode)
            at = np.array(rows)[part[got.pop("row")]]
            out["found"][at] = True
            for f, v in got.items():
                out[f][at] = v
            if mode == "ensemble" and kind == "hairpin" and len(at):
                z, pairs_of, dg = _folded(_padded([pairs[k][0] for k in at.tolist()])[0], c)
                some = z > 1
                out["fold_pairs"][at], out["fold_dg"][at] = np.where(some, pairs_of, 0.0), np.where(some, dg, 0.0)
                out["dg"][at] = np.where(some, np.minimum(out["dg"][at], dg), out["dg"][at])
    out["margin"] = out["tm"] - c.anneal_c
    return out


def _padded(strands: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes with BEHIND after each strand's end, lengths)."""
    size = np.fromiter(map(len, strands), np.int64, len(strands))
    out = np.full((len(strands), size.max(initial=0)), BEHIND, np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = CODE[np.frombuffer("".join(strands).encode(), np.uint8)]
    return out, size


def _shares(kind: str, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Rows that are computed at once: so many that their tables of runs and their stems fit in memory."""
    step = max(1, CELLS_AT_ONCE // ((a.shape[1] + 1) * (b.shape[1] + 1)))
    for start in range(0, len(a), step):
        rows = np.arange(start, min(start + step, len(a)))
        # repeats have longer runs: letters that pair, squared, bound what a row adds
        pairs = sum((a[rows] == x).sum(1) * (b[rows] == 3 - x).sum(1) for x in range(4))
        share = pairs / (a.shape[1] * b.shape[1])
        stems = pairs * np.minimum(1 / np.maximum(1 - share, 1e-3), a.shape[1]) * share * ((GAP + 1) ** 2 - 1) * (a.shape[1] if kind == "hairpin" else 1) / (b.shape[1] if kind == "hairpin" else 1)
        cut = np.searchsorted(np.cumsum(stems), np.arange(STEMS_AT_ONCE, stems.sum() + 1, STEMS_AT_ONCE))
        yield from (x for x in np.split(rows, np.unique(cut)) if len(x))


FIELDS = [tuple(f.split()) for f in SCHEMA.split(", ")]
ARROW = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def structure_of(kind: str, mode: str = "ensemble", c: Conditions = Conditions()):
    """A column function of one primer (hairpin, self-dimer) or two; its fields are null where there is no structure."""

    @F.arrow_udf(SCHEMA)
    def made(a: pa.Array, b: pa.Array) -> pa.Array:
        rows, of = distinct_rows([a, b] if kind == "cross-dimer" else [a])
        got = structures_of(kind, mode, [(r[0], r[-1]) for r in rows], c)
        none = ~got["found"]
        fields = [pa.field(f, ARROW[t]) for f, t in FIELDS]
        return pa.StructArray.from_arrays([pa.array(got[x.name], x.type, mask=none).take(of) for x in fields], fields=fields)

    def column(a: Column, b: Column | None = None) -> Column:
        return made(a, a if b is None else b)

    return column


def penalty_of(kind: str, found: Structure, binding_dg: float | None, denominator: float | None) -> float:
    """Degrees that a structure costs a primer that binds with that energy."""
    if binding_dg is None or denominator is None:
        return 0.0
    alone, one, both = WINDOWS
    window = both if found.both_anchored else one if found.anchored and kind != "hairpin" else alone
    return min(MOST_PENALTY, max(0.0, (binding_dg - found.dg + window) * 1000 / denominator))
