"""Primer pairs: panels, pools, oligo lists, self pairs and their orientations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.alphabet import normalized, reverse_complement


@dataclass(frozen=True)
class Pair:
    """Bounds of 0 inherit the query's; an effective bound of 0 is none."""

    id: str
    forward: str
    reverse: str
    min_length: int = 0
    max_length: int = 0


def pair(id: str, forward: str, reverse: str, min_length: int = 0, max_length: int = 0) -> Pair:
    return Pair(id, normalized(forward), normalized(reverse), min_length, max_length)


def parse_panel(lines: Iterable[str]) -> list[Pair]:
    """Rows of three to five fields; empty lines and those that begin with # are left out."""
    out = []
    for n, line in enumerate(lines, 1):
        fields = line.split()
        if not fields or fields[0].startswith("#"):
            continue
        if not 3 <= len(fields) <= 5:
            raise ValueError(f"line {n}: 3 to 5 fields are needed, not {len(fields)}")
        out.append(pair(*fields[:3], *map(int, fields[3:])))
    return out


def read_panel(spark: SparkSession, path: str) -> list[Pair]:
    """A panel is small by nature: it is compiled on the driver."""
    return parse_panel(r["value"] for r in spark.read.text(path).toLocalIterator())


def parse_oligos(lines: Iterable[str]) -> list[tuple[str, str]]:
    """ID:SEQ, or one or two fields; the n-th without an id is O<n>."""
    out: list[tuple[str, str]] = []
    for line in lines:
        fields = line.replace(":", " ", 1).split() if ":" in line else line.split()
        if not fields or fields[0].startswith("#"):
            continue
        if len(fields) > 2:
            raise ValueError(f"1 or 2 fields are needed: {line!r}")
        out.append((fields[0] if len(fields) == 2 else f"O{len(out) + 1}", normalized(fields[-1])))
    return out


def distinct(pool: list[str]) -> list[str]:
    """The sequences of a pool, normalized, each once in order of its first use."""
    return list(dict.fromkeys(map(normalized, pool)))


def from_pools(forwards: list[str], reverses: list[str], min_length: int = 0, max_length: int = 0) -> list[Pair]:
    """Every forward primer with every reverse one, each sequence of a pool once."""
    forwards, reverses = distinct(forwards), distinct(reverses)
    return [pair(f"F{i}+R{j}", f, r, min_length, max_length) for i, f in enumerate(forwards, 1) for j, r in enumerate(reverses, 1)]


def self_across_pools(forwards: list[str], reverses: list[str]) -> list[Pair]:
    """Every primer with every one of its own pool."""
    forwards, reverses = distinct(forwards), distinct(reverses)
    return [pair(f"{side}{i}+{side}{j}:self", a, b) for side, pool in (("F", forwards), ("R", reverses)) for i, a in enumerate(pool, 1) for j, b in enumerate(pool, 1)]


def with_self_pairs(pairs: list[Pair]) -> list[Pair]:
    return pairs + [Pair(f"{p.id}+{side}:self", s, s) for p in pairs for side, s in (("A", p.forward), ("B", p.reverse)) if s]


def with_unique_self_pairs(pairs: list[Pair]) -> list[Pair]:
    """Self pairs once for each sequence, under the id of its first use."""
    seen: dict[str, Pair] = {}
    for p in with_self_pairs(pairs)[len(pairs) :]:
        seen.setdefault(p.forward, p)
    return pairs + list(seen.values())


def oligo_pairs(oligos: list[tuple[str, str]], include_self: bool = False) -> list[Pair]:
    """All combinations of two oligos in order, and each with itself if wanted."""
    out = [Pair(f"{a}+{b}", x, y) for i, (a, x) in enumerate(oligos) for b, y in oligos[i + 1 :]]
    return out + ([Pair(f"{a}+self", x, x) for a, x in oligos] if include_self else [])


def orientations(p: Pair) -> dict[str, str]:
    """A and B as given, a and b their reverse complements."""
    return {"A": p.forward, "B": p.reverse, "a": reverse_complement(p.forward), "b": reverse_complement(p.reverse)}


def panel_table(spark: SparkSession, pairs: list[Pair]) -> DataFrame:
    rows = [(i, p.id, p.forward, p.reverse, p.min_length, p.max_length) for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "pair_ord int, pair_id string, fwd string, rev string, min_length int, max_length int")
