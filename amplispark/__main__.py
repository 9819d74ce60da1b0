"""Amplicons of FASTA files from the command line: python -m amplispark --forward ACG --reverse CGT --out folder files..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .functions.duplex import Profile
from .functions.thermo import Conditions, concentration, salt_model
from .operators import panel
from .plans.options import Options, run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="amplispark", description=__doc__)
    add = p.add_argument
    add("files", nargs="+", help="FASTA files, folders or patterns; - is the standard input")
    add("--out", required=True, help="folder to write to")
    add("--forward", help="forward primer")
    add("--reverse", help="reverse primer")
    add("--primers", help="panel: id, forward, reverse, and bounds of the length if wanted")
    add("--forward-pool", nargs="*", default=[], help="forward primers, each with every reverse one")
    add("--reverse-pool", nargs="*", default=[])
    add("--oligos", nargs="*", default=[], help="ID:SEQ or SEQ; all combinations")
    add("--self", action="store_true", help="each primer also with itself")
    add("--mismatches", type=int, default=0)
    add("--terminal-window", type=int, default=3)
    add("--min-length", type=int, default=0)
    add("--max-length", type=int, default=2000)
    add("--hit-cap", type=int, default=0)
    add("--circular", action="store_true")
    add("--format", default="tsv", help="tsv, jsonl, json, fasta or pretty")
    add("--sort", default="", help="coordinates or score")
    add("--no-header", action="store_true")
    add("--no-match-exit-code", type=int, default=1)
    add("--probe", help="probe to look for in each amplicon")
    add("--probe-name", default="probe")
    add("--probe-mismatches", type=int, default=0)
    add("--require-probe", action="store_true")
    add("--inner-forward")
    add("--inner-reverse")
    add("--require-inner", action="store_true")
    add("--score", action="store_true", help="score by how well both primers bind")
    add("--thermo-details", action="store_true")
    add("--profile", default="binding", help="binding, pcr or gel")
    add("--anneal", type=float, default=60.0, help="degrees")
    for name, usual in (("na", "50mM"), ("mg", "3mM"), ("dntp", "0"), ("primer", "250nM")):
        add(f"--{name}", type=concentration, default=concentration(usual))
    add("--salt-model", type=salt_model, default="monovalent")
    return p


def pairs_of(spark: SparkSession, a: argparse.Namespace) -> list[panel.Pair]:
    if bool(a.forward) != bool(a.reverse):
        raise ValueError("a forward and a reverse primer go together")
    if sum(map(bool, (a.forward, a.primers, a.forward_pool or a.reverse_pool, a.oligos))) != 1:
        raise ValueError("primers come from one of: forward and reverse, a panel, pools, oligos")
    if a.forward:
        return [panel.pair("manual", a.forward, a.reverse)]
    if a.primers:
        return panel.read_panel(spark, a.primers)
    if a.oligos:
        return panel.oligo_pairs(panel.parse_oligos(a.oligos), a.self)
    return panel.from_pools(a.forward_pool, a.reverse_pool) + (panel.self_across_pools(a.forward_pool, a.reverse_pool) if a.self else [])


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0, that of no match, 2 for what can't be asked, 3 for what failed, 130 if it was stopped."""
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("amplispark").getOrCreate()
    try:
        inner = [panel.pair("inner", a.inner_forward, a.inner_reverse)] if a.inner_forward else []
        o = Options(
            files=a.files, pairs=pairs_of(spark, a), max_mm=a.mismatches, window=a.terminal_window, min_length=a.min_length, max_length=a.max_length, hit_cap=a.hit_cap, circular=a.circular,
            self_pairs=a.self and bool(a.forward or a.primers), format=a.format, sort=a.sort, header=not a.no_header, no_match_exit_code=a.no_match_exit_code,
            probe=(a.probe_name, a.probe) if a.probe else None, probe_max_mm=a.probe_mismatches, require_probe=a.require_probe, inner=inner, require_inner=a.require_inner,
            score=a.score, details=a.thermo_details, profile=Profile(a.profile), conditions=Conditions(a.anneal, a.na, a.mg, a.dntp, a.primer, a.salt_model).with_defaults(),
        )
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    try:
        return run(spark, o, a.out)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        return 130
    except Exception as e:
        print(e, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
