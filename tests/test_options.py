"""What a run may be asked for, and whole runs from files to files."""

import json
import os

import pytest

from amplispark import __main__ as command
from amplispark.operators import panel
from amplispark.plans.options import Options, amplicons, run

PAIRS = [panel.pair("p", "ACGTAC", "GGTACC")]


@pytest.mark.parametrize("wrong", [
    {"files": []}, {"pairs": []}, {"max_mm": -1}, {"window": -2}, {"hit_cap": -1}, {"min_length": -1}, {"min_length": 90, "max_length": 10}, {"format": "xml"}, {"sort": "name"},
    {"no_match_exit_code": 256}, {"probe": ("x", "ACG"), "inner": PAIRS}, {"sort": "score"}, {"details": True}, {"inner": PAIRS, "format": "fasta"}, {"inner": PAIRS, "format": "pretty"},
])
def test_what_cannot_be_asked(wrong):
    with pytest.raises(ValueError):
        Options(**{"files": ["a.fa"], "pairs": PAIRS, **wrong})


def test_longest():
    assert Options(["a"], PAIRS).longest == 2000 and Options(["a"], [*PAIRS, panel.pair("q", "AC", "GT", 0, 3000)]).longest == 3000
    assert Options(["a"], PAIRS, max_length=0).longest == 0


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.fa").write_text(">r one\nTTTACGTACAAAAGGTACCTTT\n>s\nACGTACTTGGTACC\n")
    (tmp_path / "b.fa").write_text(">r\nACGTACGGTACC\n")
    return tmp_path


def lines(folder):
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    return [x for p in parts for x in (folder / p).read_text().splitlines()]


def test_runs_in_all_formats(spark, files):
    for format in ("tsv", "jsonl", "json", "fasta", "pretty"):
        o = Options([str(files / "*.fa")], PAIRS, format=format, sort="coordinates")
        assert run(spark, o, str(files / format)) == 0
    rows = [x.split("\t") for x in lines(files / "tsv") if not x.startswith("source_file")]
    assert [(r[0].rpartition("/")[2], r[1], r[3], r[4]) for r in rows if r[6] == "forward"] == [("a.fa", "r", "3", "19"), ("a.fa", "s", "0", "14"), ("b.fa", "r", "0", "12")]
    assert len(json.loads("\n".join(lines(files / "json")))) == len(rows) == len(lines(files / "jsonl"))
    assert lines(files / "json")[1].startswith("  {") and lines(files / "json")[2].startswith('    "experiment_id"')
    heads = [x for x in lines(files / "fasta") if x.startswith(">")]
    assert [x.split()[0] for x in heads] == [f">p_{i}" for i in range(1, len(rows) + 1)]
    assert sum(x.startswith("# 5'-ACGTAC-3'") for x in lines(files / "pretty")) >= 3
    none = Options([str(files / "a.fa")], [panel.pair("n", "AAAAAAAAAA", "CCCCCCCCCC")], no_match_exit_code=7)
    assert run(spark, none, str(files / "none")) == 7


def test_scores_details_probe_and_inner(spark, files):
    o = Options([str(files / "a.fa")], PAIRS, score=True, details=True, sort="score")
    got = amplicons(spark, o).collect()
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True) and got[0]["thermo_model"]
    assert run(spark, o, str(files / "details")) == 0
    table = [x.split("\t") for x in lines(files / "details")]
    assert {len(x) for x in table} == {12 + 113} and sum(x[0] == "source_file" for x in table) == 1
    assert all(r["probe_found"] for r in amplicons(spark, Options([str(files / "a.fa")], PAIRS, probe=("x", "AAAA"), require_probe=True)).collect())
    assert amplicons(spark, Options([str(files / "a.fa")], PAIRS, inner=[panel.pair("i", "CGT", "GTA")])).where("inner_found").count() > 0


def test_command_line(spark, files, capsys):
    call = lambda *more, out="cli": command.main([str(files / "a.fa"), "--out", str(files / out), *more])
    assert call("--forward", "ACGTAC", "--reverse", "GGTACC", "--score", "--na", "50mM") == 0
    assert any("\tmanual\t" in x for x in lines(files / "cli"))
    assert call("--forward", "ACGTAC", out="x") == 2 and "go together" in capsys.readouterr().err
    assert call("--forward", "ACGTAC", "--reverse", "GGTACC", "--oligos", "ACG", out="x") == 2
    assert call("--forward", "AXGTAC", "--reverse", "GGTACC", out="x") == 2
    assert call("--forward", "AAAAAAAAAAA", "--reverse", "GGTACC", "--no-match-exit-code", "5", out="y") == 5
    assert call("--oligos", "a:ACGTAC", "GGTACC", out="z") == 0
    (files / "panel.tsv").write_text("# x\np1 ACGTAC GGTACC\n")
    assert call("--primers", str(files / "panel.tsv"), "--self", out="w") == 0
    assert command.main([str(files / "missing.fa"), "--out", str(files / "v"), "--forward", "ACG", "--reverse", "ACG"]) == 3
