"""What a run is asked for, checked before anything is planned, and the plan that follows from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.duplex import Profile
from ..functions.thermo import Conditions
from ..operators import annotate, details, panel, products, scoring
from ..session import ship
from ..sources import fasta, pretty, sinks


@dataclass
class Options:
    """Primers come from `pairs`, inline or read from a panel, and records from FASTA files."""

    files: list[str] = field(default_factory=list)
    pairs: list[panel.Pair] = field(default_factory=list)
    max_mm: int = 0
    #: Protected bases at a primer's 3' end; below 1 there are none.
    window: int = 3
    min_length: int = 0
    max_length: int = products.MOST_LENGTH
    hit_cap: int = 0
    circular: bool = False
    self_pairs: bool = False
    format: str = "tsv"
    #: "coordinates", "score" or "": rows as they come.
    sort: str = ""
    header: bool = True
    no_match_exit_code: int = 1
    probe: tuple[str, str] | None = None
    probe_max_mm: int = 0
    require_probe: bool = False
    inner: list[panel.Pair] = field(default_factory=list)
    require_inner: bool = False
    score: bool = False
    details: bool = False
    profile: Profile = field(default_factory=Profile)
    conditions: Conditions = field(default_factory=Conditions)

    def __post_init__(self):
        wrong = [
            text
            for bad, text in (
                (not self.files, "a sequence file is needed"),
                (not self.pairs, "primers are needed"),
                (self.max_mm < 0 or self.probe_max_mm < 0, "mismatches can't be negative"),
                (self.window < -1, "the protected window is -1 at least"),
                (self.hit_cap < 0, "the cap of sites can't be negative"),
                (self.min_length < 0 or self.max_length < 0, "lengths can't be negative"),
                (0 < self.max_length < self.min_length, "the least length is over the greatest"),
                (self.format not in (*sinks.FORMATS, "pretty"), f"no format: {self.format!r}"),
                (self.sort not in ("", "coordinates", "score"), f"no order: {self.sort!r}"),
                (not 0 <= self.no_match_exit_code <= 255, "an exit code is 0 to 255"),
                (bool(self.probe) and bool(self.inner), "a probe and inner primers don't go together"),
                ((self.sort == "score" or self.details) and not self.score, "scores have to be asked for"),
                (self.format == "fasta" and bool(self.inner), "nested amplicons have no FASTA form"),
                (self.format == "pretty" and bool(self.inner), "nested amplicons aren't drawn"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def kind(self) -> str:
        return "probe" if self.probe else "nested" if self.inner else "product"

    @property
    def longest(self) -> int:
        """The greatest length that any pair may have; 0 if one is unbounded."""
        each = [p.max_length or self.max_length for p in self.pairs]
        return 0 if 0 in each else max(each)


def amplicons(spark: SparkSession, o: Options) -> DataFrame:
    """The rows that a run gives, in its order: amplicons with their bases, and what else was asked for."""
    ship(spark)
    pairs = panel.with_unique_self_pairs(o.pairs) if o.self_pairs else o.pairs
    records = fasta.read_fasta(spark, *o.files)
    # ids may repeat between files
    keyed = records.select(F.concat_ws("\t", "source_file", "record").alias("record"), "seq")
    found = products.amplicons(keyed, pairs, o.max_mm, max(o.window, 0), o.min_length, o.max_length, o.circular, o.hit_cap)
    rows = products.with_sequences(found, keyed)
    parts = F.split("record", "\t", 2)
    rows = rows.withColumns({"source_file": parts[0], "sequence_id": parts[1]})
    if o.score or o.format == "pretty":
        rows = scoring.with_sites(scoring.with_primers(rows, pairs))
    if o.score:
        rows = scoring.scored(rows, o.conditions, o.profile)
    if o.details:
        rows = details.with_details(rows, o.conditions, o.profile)
    if o.probe:
        rows = annotate.with_probe(rows, *o.probe, o.probe_max_mm, o.require_probe)
    if o.inner:
        rows = annotate.with_nested(rows, o.inner, o.max_mm, max(o.window, 0), require=o.require_inner)
    if o.sort:
        order = scoring.score_order(rows) if o.sort == "score" else products.coordinate_order(rows)
        rows = rows.orderBy(*order)
    return rows


def run(spark: SparkSession, o: Options, path: str) -> int:
    """Write what a run gives, and return its exit code: 0, or no_match_exit_code if there is no row."""
    rows = amplicons(spark, o)
    if o.format == "fasta":
        rows = products.numbered(rows, scoring.score_order(rows) if o.sort == "score" else products.coordinate_order(rows))
    if o.format == "pretty":
        pretty.blocks(rows).select(F.concat(F.concat_ws("\t", *[F.col(c).cast("string") for c in sinks.PRODUCT]), F.lit("\n"), F.col("block")).alias("value")).write.text(path)
        written = spark.read.text(path)
    elif o.format == "tsv" and o.details:
        columns = sinks.with_score(sinks.PRODUCT)
        both = F.concat_ws("\t", sinks.tsv_value(rows, columns), details.detail_value(rows))
        sinks.write_lines(rows.select(both.alias("value")), path, "\t".join((*columns, *details.COLUMNS)) if o.header else None)
        written = spark.read.text(path).offset(int(o.header))
    else:
        sinks.write(rows, path, o.format, o.kind, o.header)
        written = spark.read.text(path)
        if o.format == "json":
            written = written.where("value not in ('[', ']')")
        elif o.format == "tsv" and o.header:
            written = written.where(~F.col("value").startswith("source_file\t"))
    return o.no_match_exit_code if written.isEmpty() else 0
