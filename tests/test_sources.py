from strandloom.operators import bwt, graph
from strandloom.sources import readers
from strandloom.streaming import reads as stream


def test_lines_are_numbered_without_empty_ones(spark, tmp_path):
    (tmp_path / "r.txt").write_text("ACG\n\nTT\nG")
    assert [tuple(r) for r in readers.read_lines(spark, str(tmp_path / "r.txt")).orderBy("seq").collect()] == [(0, "ACG"), (1, "TT"), (2, "G")]


def test_gfa_round_trip(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1.0\nS\t1\tACG\nS\t2\tTT\nL\t1\t+\t2\t-\t0M\nP\tx\t1+,2-,1-\t*\n")
    nodes, edges, steps = readers.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert edges.first().asDict() == {"u": 1, "u_rev": False, "v": 2, "v_rev": True}
    assert [(r.node_id, r.is_rev, r.node_start) for r in steps.orderBy("step").collect()] == [(1, False, 0), (2, True, 3), (1, True, 5)]
    assert readers.path_sequences(nodes, steps).first().t == "ACGAACGT"


def test_gfa_with_names_and_walks(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("S\ts2\tACG\nS\ts10\tTT\nL\ts2\t+\ts10\t-\t0M\nW\tx\t1\tchr\t0\t8\t>s2<s10<s2\nP\ta\ts10-,s2+\t*\n")
    nodes, edges, steps = readers.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert sorted((r.node_id, r.name) for r in nodes.collect()) == [(1, "s10"), (2, "s2")]
    assert tuple(edges.first()) == (2, False, 1, True)
    assert [tuple(r) for r in steps.orderBy("seq", "step").collect()] == [(0, 0, 1, True, 0, 2), (0, 1, 2, False, 2, 3), (1, 0, 2, False, 0, 3), (1, 1, 1, True, 3, 2), (1, 2, 2, True, 5, 3)]
    assert [r.t for r in readers.path_sequences(nodes, steps).orderBy("seq").collect()] == ["AAACG", "ACGAACGT"]


def test_index_folder(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "GATTAC"), (1, "AGATAC")], "seq long, t string")
    sa = bwt.suffix_array(seqs)
    readers.save_index(str(tmp_path / "i"), sa=sa, seqs=seqs)
    back = readers.load_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, back["sa"].collect())) == sorted(map(tuple, sa.collect()))
    assert readers.files_of(spark, str(tmp_path / "i/sa/*.parquet")).count() >= 1


def test_streamed_reads(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "GATTACA")], "seq long, t string")
    seeds = graph.kmer_intervals(seqs, 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("ATTAC\n\nCCCCC\n")
    q = stream.seed_hits(stream.stream_lines(spark, str(tmp_path / "in")), seeds, 4).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.t, r.a) for r in spark.sql("select * from hits").collect()) == [("ATTAC", 0), ("ATTAC", 1)]
