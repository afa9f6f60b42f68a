"""Readers and writers, and the streaming surface, through real files."""

import struct

import pytest
from pyspark.sql import functions as F

from colinear.schemas import PAIRWISE, TABULAR_HIT
from colinear.sources import readers as rd, writers as wr
from colinear.streaming import deltas


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text) if isinstance(text, str) else p.write_bytes(text)
    return str(p)


def test_fasta_and_chunks(spark, tmp_path):
    f = rd.fasta(spark, put(tmp_path, "g.fa", ">a first\nACGT\nAC\n>b\nGG\n"), "o")
    assert [(r.ordinal, r.seqid, r.seq, r.length) for r in f.orderBy("ordinal").collect()] == [(0, "a", "ACGTAC", 6), (1, "b", "GG", 2)]
    assert [(r.seqid, r.chunk_no, r.start, r.seq) for r in rd.chunks(f, 4, 1).orderBy("seqid", "chunk_no").collect()] == [
        ("a", 0, 0, "ACGT"), ("a", 1, 3, "TAC"), ("b", 0, 0, "GG")]


def test_kmer_vector(spark, tmp_path):
    path = put(tmp_path, "v.bin", struct.pack("<5H", 1, 0, 300, 65535, 7))
    assert [(r.pos, r.freq) for r in rd.kmer_vector(spark, path, "o", block=2).orderBy("pos").collect()] == [(0, 1), (1, 0), (2, 300), (3, 65535), (4, 7)]


def test_complexity_stops_at_an_unknown_sequence(spark, tmp_path):
    known = spark.createDataFrame([("a",)], "seqid string")
    good = rd.complexity(spark, put(tmp_path, "c", "a 500 0.5\n"), known, "o")
    assert good.first().midpoint == 500
    with pytest.raises(Exception, match="unknown sequence b"):
        rd.complexity(spark, put(tmp_path, "d", "b 500 0.5\n"), known, "o").collect()


def test_hits(spark, tmp_path):
    text = "# c\nC\tq\ts\t1\t9\t30\t20\t50\nC\tq\ts\t1\t9\t3\t9\t40\n"
    (r,) = rd.chained_hits(spark, put(tmp_path, "h", text)).collect()
    assert (r.s_start, r.s_end, r.orientation, r.score) == (20, 30, "reverse", 50.0)
    cf = "#\nC\tq\ts\t1\t9\t1\t9\t50\nF\tq\ts\t1\t4\t1\t4\t20\nF\tq\ts\t6\t9\t6\t9\t30\nC\tq\tt\t1\t2\t1\t2\t9\n"
    got = rd.chain_fragments(spark, put(tmp_path, "cf", cf)).orderBy("record").collect()
    assert [(g.subject, g.score, len(g.fragments)) for g in got] == [("s", 50.0, 2), ("t", 9.0, 0)]
    row = "q\ts\t99.0\t10\t0\t0\t1\t10\t1\t10\t1e-5\t50\n"
    assert rd.tabular_hits(spark, put(tmp_path, "t", row), TABULAR_HIT).first().bitscore == 50
    with pytest.raises(Exception):
        rd.tabular_hits(spark, put(tmp_path, "u", "q\ts\tx\n"), TABULAR_HIT).collect()


def test_gff(spark, tmp_path):
    g = rd.gff3(spark, put(tmp_path, "a.gff", "##gff\nc\tx\tgene\t1\t9\t.\t+\t.\tID=g1;Name=n;\nshort\tline\n"))
    assert [(r.seqid, r.start, r.attrs["ID"]) for r in g.collect()] == [("c", 1, "g1")]
    text = ("##STA MKV\nc\tm\tmRNA\t1\t90\t5\t-\t.\tID=M1;Identity=0.9;Rank=1;Frameshift=2;Target=p 1 30\n"
            "c\tm\tCDS\t1\t30\t.\t-\t0\tParent=M1\nc\tm\tCDS\t60\t90\t.\t-\t0\tParent=M1\n")
    (m,) = rd.spliced_gff(spark, put(tmp_path, "s.gff", text)).collect()
    assert (m.protein, m.identity, m.frameshifts, m.stop_codons, [tuple(x) for x in m.cds]) == ("MKV", 0.9, 2, 0, [(1, 30), (60, 90)])


def test_collinearity_and_aliases(spark, tmp_path):
    text = ("# head\n## Alignment 0: score=250.0 e_value=1e-9 N=2 1orgchr1&2orgchr3 plus\n  0-  0:\te1\te2\t0\n  0-  1:\te3\te4\t0\n"
            "## Alignment 1: score=50.0 e_value=1 N=1 1orgchr1&2orgchr1 minus\n  1-  0:\te5\te6\t0\n")
    blocks, pairs = rd.collinearity(spark, put(tmp_path, "x", text))
    assert [(b.block_id, b.score, b.n_pairs, b.orientation) for b in blocks.orderBy("record").collect()] == [(0, 250.0, 2, "plus"), (1, 50.0, 1, "minus")]
    assert [(p.block_id, p.pos, p.elem1) for p in pairs.orderBy("block_id", "pos").collect()] == [(0, 0, "e1"), (0, 1, "e3"), (1, 0, "e5")]
    a = rd.alias_sections(spark, put(tmp_path, "al", "# 1org spec\n1orgchr1 c1\n1orgchr2 c2\n# 2org other\n2orgchr1 d\n"))
    assert sorted(map(tuple, a.collect())) == [("1org", "spec", "1orgchr1", "c1"), ("1org", "spec", "1orgchr2", "c2"), ("2org", "other", "2orgchr1", "d")]


def test_tables(spark, tmp_path):
    row = "1\ta\tc\t9\t5\tb\td\t1\t2\tforward\t50\tNA\tNA\n"
    (p,) = rd.pairwise_alignments(spark, put(tmp_path, "p", row + "bad line\n"), PAIRWISE).collect()
    assert (p.start1, p.end1, p.score12) == (5, 9, None)
    (c,) = rd.coords(spark, put(tmp_path, "co", "o\tc\t9\t5\tforward\n")).collect()
    assert (c.start, c.end, c.name) == (5, 9, "o_c_5_9")
    assert rd.strand_table(spark, put(tmp_path, "s", "c\t9\t5\tminus\n")).first().strand == "-"
    og = rd.orthogroups(spark, put(tmp_path, "og", "id\ta\tb\nS0\tx, y\t\nS1\t\tz\n"))
    assert sorted(map(tuple, og.collect())) == [("S0", "a", "x"), ("S0", "a", "y"), ("S1", "b", "z")]
    assert rd.parameters(spark, put(tmp_path, "pa", "# c\no\t50\t4\t21\t2\t300\t50\t16\t90\t10\t10\n"), "dups").first().flag == 0
    assert [r.org for r in rd.names(spark, put(tmp_path, "n", "# c\na\na\n")).collect()] == ["a"]


def test_exports(spark, tmp_path):
    cand = spark.createDataFrame([("o", 5, "c", 1, 9, "ACG"), ("o", 2, "c", 0, 3, "GGT")], "org string, anchor_id long, seqid string, rel_start long, end long, seq string")
    fa = wr.query_fasta(cand, reverse=True)
    assert [r.line for r in fa.orderBy("line_no").collect()] == [">kmer$2$c$0$3\nACC", ">kmer$5$c$1$9\nCGT"]
    wr.write_lines(fa, str(tmp_path / "out"), ["org"])
    assert (tmp_path / "out" / "org=o").is_dir()
    placed = spark.createDataFrame([("s", 0, "x", "forward"), ("s", 1, "y", "reverse")], "scaffold string, pos int, contig string, orientation string")
    contigs = spark.createDataFrame([("x", "AAC"), ("y", "GGA"), ("z", "T")], "contig string, seq string")
    assert dict(map(tuple, wr.scaffold_fasta(placed, contigs, 3).collect())) == {"s": "AACNNNTCC", "z": "T"}
    lines = wr.as_lines(spark.createDataFrame([(1, None)], "a int, b string"), ["a"])
    assert lines.first().line == "1\tNA"
    region = spark.createDataFrame([("o", "c", 2, 5)], "org string, seqid string, start long, end long")
    chunk = spark.createDataFrame([("o", "c", 0, "ACGTAC"), ("o", "c", 1, "CGTACG")], "org string, seqid string, start long, seq string")
    assert wr.region_fasta(region, chunk).first().line == ">o_c_2_5_forward\nGTA"


def test_pairwise_table(spark):
    m = spark.createDataFrame([("a", 1, "b", 2, "regular", 50.0, 0, 5, 1, 6, False, False), ("b", 2, "a", 1, "regular", 50.0, 1, 6, 0, 5, False, False), ("a", 1, "b", 3, "dup", 9.0, 0, 5, 0, 5, True, True)],
                              "org1 string, id1 long, org2 string, id2 long, kind string, score double, own_start int, own_end int, other_start int, other_end int, inverted boolean, syntenic boolean")
    c = spark.createDataFrame([("a", 1, "c", 100), ("b", 2, "d", 200), ("b", 3, "d", 300)], "org string, anchor_id long, seqid string, start long")
    o = spark.createDataFrame([("a", 1), ("b", 0)], "org string, rank int")
    assert [(r.org1, r.start1, r.org2, r.start2) for r in wr.pairwise_table(m, c, o).collect()] == [("b", 201, "a", 100)]


def test_tombstone_stream(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1)], "org1 string, id1 long, org2 string, id2 long")
    src, state = str(tmp_path / "stones"), {"t": m}
    spark.createDataFrame([("b", 2, "a", 1)], "dst_org string, dst_id long, src_org string, src_id long").write.parquet(src)
    stream = spark.readStream.schema("dst_org string, dst_id long, src_org string, src_id long").parquet(src)

    def save(df, batch):
        df.write.mode("overwrite").parquet(str(tmp_path / f"v{batch}"))
        state["t"] = spark.read.parquet(str(tmp_path / f"v{batch}"))

    deltas.merge_tombstones(stream, lambda: state["t"], save, str(tmp_path / "ck")).awaitTermination(60)
    assert [tuple(r) for r in state["t"].collect()] == [("a", 1, "b", 2)]


def test_time_windows_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(i, i * 600, "x", 1.0) for i in range(12)], "user_id long, s long, event_type string, value double").select(
        "user_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value").write.parquet(src)
    ev = spark.readStream.schema("user_id long, ts timestamp, event_type string, value double").parquet(src)
    q = deltas.tumbling_scores(ev).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("w").collect()) == [6, 6]
