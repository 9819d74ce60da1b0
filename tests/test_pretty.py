"""Blocks of amplicons, line by line, against drawings made by hand."""

import pytest
from pyspark.sql import functions as F

from amplispark.operators import annotate, panel, scoring
from amplispark.operators.hits import hits
from amplispark.operators.products import products, with_sequences
from amplispark.sources import pretty

FORWARD = """\
# 5'-AAA-3'
#    |||-->
# 5'-AAA................-3' # (+)
# 3'-................AAA-5' # (-)
#                 <--|||
#                 3'-TTT-5'
#
"""
PLUS = """\
# 5'-TCAG-3'  5'-GTACGT-3' probe (+)
#    ||||-->     ||||||
# 5'-TCAG........GTACGT..................-3' # (+)
# 3'-................................CTAG-5' # (-)
#                                 <--||||
#                                 3'-CTAG-5'
# probe "probe" (+) pos=12 mm=0 site=GTACGT fwd_mm=0@[] rev_mm=0@[]
#
"""
MINUS = """\
# 5'-TCAGGCCTTTGCTACAATGAAC-3'
#    ||||||||||||||||||||||-->
# 5'-TCAGGCCTTTGCTACAAYGAAC..........................................................................................-3' # (+)
# 3'-....................................................TCATACACTATACTACGTCAA.................AGTCCGGAAACGATGTTACTTG-5' # (-)
#                                                        |||||||||||||||||||||              <--||||||||||||||||||||||
#                                           probe (-) 3'-TCATACACTATACTACGTCAA-5'           3'-CAAGTAACATCGTTTCCGGACT-5'
# probe "probe" (-) pos=52 mm=0 site=AGTATGTGATATGATGCAGTT fwd_mm=0@[] rev_mm=0@[]
#
"""
NEAR = """\
# 5'-GTTTACCCATATCTTTGACGCTCTTA-3'
#    ||||||||||||||||||||||||||-->
# 5'-GTTTACCCATATCTTTGACGCTCTTA........................................................-3' # (+)
# 3'-...........................AAGAAGGTCGTGGCT...............CCTTTCTGTATAGGGTTATGTCGTT-5' # (-)
#                               |||||||||||||||            <--|||||||||||||||||||||||||
#                  probe (-) 3'-AAGAAGGTCGTGGCT-5'         3'-AACGACATAACCCTATACAGAAAGG-5'
# probe "probe" (-) pos=27 mm=0 site=TTCTTCCAGCACCGA fwd_mm=0@[] rev_mm=0@[]
#
"""


def row(fwd, rev, length, fwd_site="", rev_site="", fwd_bad="", rev_bad=""):
    return {"fwd": fwd, "rev": rev, "fwd_site": fwd_site or fwd, "rev_site": rev_site or rev, "length": length, "fwd_mm_i": fwd_bad, "rev_mm_i": rev_bad}


def probe(seq, strand, pos, site, found=True):
    return dict(zip(pretty.PROBE_COLUMNS, ("probe", seq, found, strand, pos, 0, site), strict=True))


@pytest.mark.parametrize("got, want", [
    (pretty.block(row("AAA", "TTT", 22)), FORWARD),
    (pretty.block(row("TCAG", "GATC", 40), probe("GTACGT", "+", 12, "GTACGT")), PLUS),
    (pretty.block(row("TCAGGCCTTTGCTACAATGAAC", "TCAGGCCTTTGCTACAATGAAC", 112, "TCAGGCCTTTGCTACAAYGAAC"), probe("AACTGCATCATATCACATACT", "-", 52, "AGTATGTGATATGATGCAGTT")), MINUS),
    (pretty.block(row("GTTTACCCATATCTTTGACGCTCTTA", "GGAAAGACATATCCCAATACAGCAA", 68), probe("TCGGTGCTGGAAGAA", "-", 27, "TTCTTCCAGCACCGA")), NEAR),
])
def test_blocks(got, want):
    assert got == want


def test_a_probe_on_a_primer_has_lines_of_its_own_and_a_missing_one_none():
    lines = pretty.block(row("TCAG", "GATC", 40), probe("GTACGT", "+", 5, "GTACGT")).splitlines()
    assert lines[2:4] == ["#      5'-GTACGT-3' probe (+)", "#         ||||||"] and lines[4].startswith("# 5'-TCAG.GTACGT")
    none = pretty.block(row("TCAG", "GATC", 40, rev_bad="1,2"), probe("GGG", None, None, None, False)).splitlines()
    assert none[-2] == '# probe "probe" NOT FOUND fwd_mm=0@[] rev_mm=2@[1,2]' and none[4].endswith("<--|  |") and len(none) == 8
    assert pretty.block(row("A", "", 3)) == pretty.MISSING
    assert "¦" in pretty.block(row("ACN", "TTT", 22))


def test_blocks_of_amplicons(spark):
    pairs = [panel.pair("p", "ACGTAC", "GGTACC")]
    records = spark.createDataFrame([("s", "TTTACGTACAAAAGGTACCTTT")], "record string, seq string")
    rows = with_sequences(products(hits(records, pairs, 1), pairs), records)
    rows = scoring.with_sites(scoring.with_primers(rows, pairs))
    for r in rows.collect():
        assert r["fwd_site"] == r["seq"][: len(r["fwd"])] and len(r["rev_site"]) == len(r["rev"])
    drawn = pretty.blocks(rows).where("fwd_mm = 0 and rev_mm = 0 and type = 'forward'").first()["block"]
    assert drawn.splitlines()[2] == "# 5'-ACGTAC...........-3' # (+)"
    both = pretty.blocks(annotate.with_probe(rows, "x", "AAAA")).where(F.col("block").contains('probe "x"'))
    assert both.count() == rows.count()
