"""Files that arrive in a folder, taken in two runs."""

from amplispark.operators import panel
from amplispark.streaming.amplicons import amplicons_of, stream_amplicons
from amplispark.sources.fasta import read_fasta

PAIRS = [panel.pair("p", "ACGTAC", "GGTACC")]


def test_each_amplicon_once_over_runs(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.fa").write_text(">r one\nACGTACAA\nGGTACC\n>s\nTTTT\n")

    def run():
        stream_amplicons(spark, str(folder), PAIRS, out, str(tmp_path / "state"), files_per_batch=1).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(out).select("source_file", "sequence_id", "start", "end", "type").collect())

    assert [r[1:] for r in run()] == [("r", 0, 14, "forward")]
    (folder / "b.fa").write_text(">r\nTTACGTACAAGGTACC\n")
    got = run()
    assert [r[1:] for r in got] == [("r", 0, 14, "forward"), ("r", 2, 16, "forward")]
    whole = amplicons_of(read_fasta(spark, str(folder)), PAIRS).select("source_file", "sequence_id", "start", "end", "type")
    assert sorted(tuple(r) for r in whole.collect()) == got
    assert run() == got


def test_pieces_that_arrive_apart_give_each_amplicon_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    whole = "TTTTACGTACAAGGTACCTTTTACGTACTTGGTACCAA"
    pieces = {f"r:{a}-{min(a + 25, len(whole))}": whole[a : a + 25] for a in (0, 10, 20)}

    def run():
        stream_amplicons(spark, str(folder), PAIRS, out, str(tmp_path / "state"), files_per_batch=1, pieces=True, max_length=20).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(out).select("sequence_id", "start", "end", "type").collect())

    for name, seq in list(pieces.items())[:2]:
        (folder / f"{name.replace(':', '_')}.fa").write_text(f">{name}\n{seq}\n")
    run()
    name, seq = list(pieces.items())[2]
    (folder / "last.fa").write_text(f">{name}\n{seq}\n")
    got = run()
    records = spark.createDataFrame([("f", "r", whole)], "source_file string, record string, seq string")
    want = amplicons_of(records, PAIRS, max_length=20).select("sequence_id", "start", "end", "type")
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) >= 2
