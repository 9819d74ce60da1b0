"""IUPAC alphabet: masks, complement, validation, expansion, and DNA derived from text."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases that each IUPAC letter stands for, and complements.
BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
LETTERS, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
MASK = {c: sum(1 << "ACGT".index(b) for b in bases) for c, bases in BASES.items()}

LOWER = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DNA = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"


def dna(text: Column) -> Column:
    """Nucleotides derived from any text; what is no letter becomes N."""
    return F.regexp_replace(F.translate(text, LOWER, DNA), "[^ACGT]", "N")


def dna_sql(text: str) -> str:
    return f"regexp_replace(translate({text}, '{LOWER}', '{DNA}'), '[^ACGT]', 'N', 'g')"


def reverse_complement(seq: str) -> str:
    return seq.translate(str.maketrans(LETTERS, COMPLEMENTS))[::-1]


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))


def normalized(raw: str) -> str:
    """Upper case without spaces and quotes; raises if empty or outside the IUPAC letters."""
    seq = re.sub(r"[\s'\"]", "", raw).upper()
    if not seq or set(seq) - set(LETTERS):
        raise ValueError(f"no IUPAC nucleotide sequence: {raw!r}")
    return seq


def validated(raw: Column) -> Column:
    """The normalized sequence of a column; a query over an invalid one fails."""
    seq = F.upper(F.regexp_replace(raw, r"[\s'\"]", ""))
    return F.when(seq.rlike(f"^[{LETTERS}]+$"), seq).otherwise(F.raise_error(F.concat(F.lit("no IUPAC nucleotide sequence: "), raw)))


def matches(p: str, g: str) -> bool:
    """Whether two IUPAC letters, of either case, have a base in common; letters outside the alphabet match nothing."""
    return bool(MASK.get(p.upper(), 0) & MASK.get(g.upper(), 0))


def matches_letters(p: Column, g: Column) -> Column:
    """The same for columns of single letters."""
    table = F.create_map(*[F.lit(x) for c, m in MASK.items() for x in (c, m)])
    return F.coalesce(table[F.upper(p)].bitwiseAND(table[F.upper(g)]) != 0, F.lit(False))


def slices(seq: Column, starts: Column, size: int) -> Column:
    """array of struct(at, seq): size bytes from each start.

    Bytes are cut, not letters of a string, which would be counted from its
    beginning for each cut; the record is bound once, so it isn't converted again.
    """
    cut = lambda r: F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring(r, (at + 1).cast("int"), F.lit(size)).alias("seq")))
    return F.flatten(F.transform(F.array(seq.cast("binary")), cut))


def gc_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(seq, "[^GC]", "")) / F.length(seq)).otherwise(0.0)


def expanded(seq: Column, most: int) -> Column:
    """Concrete sequences in order of bases A < C < G < T, cut to the first `most` after each letter."""
    table = F.create_map(*[F.lit(x) for c, b in BASES.items() for x in (c, b)])
    letters = F.split(seq, "")
    grow = lambda done, c: F.slice(F.flatten(F.transform(done, lambda d: F.transform(F.split(table[c], ""), lambda b: F.concat(d, b)))), 1, most)
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.array(F.lit("")), grow)


def expansions(seq: str, most: int) -> list[str]:
    """The first `most` plain sequences that seq stands for, in order of bases."""
    return ["".join(x) for x in itertools.islice(itertools.product(*[BASES[c] for c in seq]), most)]
