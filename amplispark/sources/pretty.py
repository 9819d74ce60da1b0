"""Amplicons as blocks of text: both primers over the template they bind, and a probe between them.

A block is drawn on lines that grow as text is placed on them. The stretch
between the primers is drawn short: as long as it is, but at most `most` dots,
and wide enough for the other strand's primer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import BASES, COMPLEMENTS, LETTERS
from ..functions.batched import distinct_rows

#: Dots between the primers at most, and dots that stay beyond the other strand's primer at least.
MOST_DOTS, LEAST_DOTS = 95, 5
#: Marks of a block.
EXACT, PARTIAL, DOT, RIGHT, LEFT = "|", "¦", ".", "-->", "<--"
MISSING = "# (pretty not available: sites missing)\n\n"
COMPLEMENT = str.maketrans(LETTERS, COMPLEMENTS)
COLUMNS = ("fwd", "rev", "fwd_site", "rev_site", "length", "fwd_mm_i", "rev_mm_i")
PROBE_COLUMNS = ("probe_name", "probe_seq", "probe_found", "probe_strand", "probe_pos", "probe_mm", "probe_site")


def mark(letter: str) -> str:
    return EXACT if letter in "ACGT" else PARTIAL


def bars(primer: str, site: str, bad: set[int]) -> str:
    """A mark under each letter of the primer that binds."""
    return "".join(" " if i in bad else mark(c) for i, c in enumerate(primer[: len(site)]))


def placed(*parts: tuple[int, str]) -> str:
    """A line with each text at its column, later ones over earlier ones; spaces at its end are left out."""
    line: list[str] = []
    for at, text in parts:
        text, at = text[max(-at, 0) :], max(at, 0)
        line += " " * (at + len(text) - len(line))
        line[at : at + len(text)] = text
    return "".join(line).rstrip(" ")


def places(csv: str) -> set[int]:
    return {int(x) for x in csv.split(",")} if csv else set()


@dataclass
class Probe:
    """The part of a probe that is drawn: its column among the dots, template and probe letters under each other."""

    at: int
    site: str
    letters: str

    @property
    def bars(self) -> str:
        return "".join(mark(p) if s in BASES.get(p, "") else " " for s, p in zip(self.site, self.letters, strict=True))


def probe_part(probe: dict, first: int, between: int, width: int) -> Probe | None:
    """first: length of the left primer, between: bases between the primers, width: the dots that stand for them."""
    site, letters, at = probe["probe_site"] or "", probe["probe_seq"] or probe["probe_site"] or "", probe["probe_pos"]
    if not probe["probe_found"] or not site or between <= 0 or width <= 0:
        return None
    if probe["probe_strand"] == "-":
        site, letters = site.translate(COMPLEMENT), letters[::-1]
    hidden = max(first - at, 0)  # under the primer
    n = min(len(site), len(letters))
    site, letters, at = site[hidden:n], letters[hidden:n], max(at, first)
    if not site or at >= first + between:
        return None
    off = min(at - first, between - 1) * (width - 1) // (between - 1) if between > 1 and width > 1 else 0
    room = width - off
    return Probe(off, site[:room], letters[:room]) if room > 0 else None


def overlap(a: int, text: str, b: int, other: str) -> bool:
    return bool(text and other) and a < b + len(other) and b < a + len(text)


def block(row: dict, probe: dict | None = None, most: int = MOST_DOTS) -> str:
    """The lines of one amplicon: fwd and rev are primers, fwd_site and rev_site the bases each binds, read in its direction."""
    fwd, rev, fwd_site, rev_site = (row[c] or "" for c in COLUMNS[:4])
    if not (fwd and rev and fwd_site and rev_site):
        return MISSING
    between = max(row["length"] - len(fwd) - len(rev), 0)
    dots = min(most if most > 0 else MOST_DOTS, between)
    whole = max(len(fwd) + max(dots, len(rev) + LEAST_DOTS), len(rev) + max(dots, len(fwd) + LEAST_DOTS))
    above, below = whole - len(fwd), whole - len(rev)
    minus = bool(probe and probe["probe_found"] and probe["probe_strand"] == "-" and probe["probe_site"])
    part = probe_part(probe, len(fwd), between, below if minus else above) if probe else None
    # a probe of the lower strand is drawn at its place in the amplicon, behind the left primer's stretch
    shift = len(fwd) if minus else 0
    upper, lower = DOT * (above + shift), DOT * (below + shift)
    if part and minus:
        lower = placed((0, lower), (shift + part.at, part.site))
    elif part:
        upper = placed((0, upper), (part.at, part.site))

    top, under = [(0, f"5'-{fwd}-3'")], [(3, bars(fwd, fwd_site, places(row["fwd_mm_i"])) + RIGHT)]
    back = 3 + len(lower)
    bottom, over = [(back - 3, f"3'-{rev[::-1]}-5'")], [(back - 3, LEFT + bars(rev, rev_site, places(row["rev_mm_i"]))[::-1])]
    extra_top, extra_bottom = [], []
    name = (probe["probe_name"] or "probe") if probe else ""
    if part and not minus:
        at = 3 + len(fwd) + part.at
        text = f"5'-{part.letters}-3' {name} (+)"
        if overlap(at - 3, text, *top[0]) or overlap(at, part.bars, *under[0]):
            extra_top = [placed((at - 3, text)), placed((at, part.bars))]
        else:
            top.append((at - 3, text))
            under.append((at, part.bars))
    elif part:
        at = 3 + shift + part.at
        text = f"{name} (-) 3'-{part.letters}-5'"
        start = at - len(text) + len(part.letters) + 3
        if overlap(start, text, *bottom[0]) or overlap(at, part.bars, *over[0]):
            extra_bottom = [placed((at, part.bars)), placed((start, text))]
        else:
            bottom.append((start, text))
            over.append((at, part.bars))
    lines = [placed(*top), placed(*under), *extra_top, f"5'-{fwd_site}{upper}-3' # (+)", f"3'-{lower}{rev_site.translate(COMPLEMENT)}-5' # (-)", *extra_bottom, placed(*over), placed(*bottom)]
    if probe:
        found = f"({probe['probe_strand']}) pos={probe['probe_pos']} mm={probe['probe_mm']} site={probe['probe_site']}" if probe["probe_found"] else "NOT FOUND"
        wrong = " ".join(f"{end}_mm={len(places(row[f'{end}_mm_i']))}@[{row[f'{end}_mm_i'] or ''}]" for end in ("fwd", "rev"))
        lines.append(f'probe "{probe["probe_name"] or ""}" {found} {wrong}')
    return "".join(f"# {x}\n" for x in lines) + "#\n"


@lru_cache(1 << 15)
def _remembered(values: tuple, probed: bool, most: int) -> str:
    """block() of the values of COLUMNS, and of PROBE_COLUMNS if probed."""
    row = dict(zip((*COLUMNS, *(PROBE_COLUMNS if probed else ())), values, strict=True))
    return block(row, row if probed else None, most)


def blocks(rows: DataFrame, most: int = MOST_DOTS) -> DataFrame:
    """rows as scoring.with_sites() gives them, with the probe's columns or without, and their block as column block."""
    names = [*COLUMNS, *(PROBE_COLUMNS if "probe_found" in rows.columns else ())]

    @F.arrow_udf("string")
    def drawn(found: pa.Array) -> pa.Array:
        rows, of = distinct_rows(found.flatten())
        return pa.array([_remembered(r, len(names) > len(COLUMNS), most) for r in rows], pa.string()).take(of)

    return rows.withColumn("block", drawn(F.struct(*names)))
