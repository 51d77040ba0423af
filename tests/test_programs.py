from pyspark.sql import functions as F

from strandloom import programs
from strandloom.operators import tags
from tests.brute import mems, suffixes

GFA = "S\ta\tGATTACA\nS\tb\tCCG\nS\tc\tTTTTGACG\nL\ta\t+\tb\t+\t0M\nL\tb\t+\tc\t-\t0M\nS\td\tACCAG\nS\te\tGGGAT\nL\td\t+\te\t+\t0M\nP\tp1\ta+,b+,c-\t*\nP\tp2\ta+,c-\t*\nP\tp3\td+,e+\t*\n"
SEQS = ["GATTACACCGCGTCAAAA", "GATTACACGTCAAAA", "ACCAGGGGAT"]


def test_from_a_graph_to_matches_tags_and_merged_parts(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(GFA)
    index = programs.build_tags(spark, str(tmp_path / "g.gfa"), str(tmp_path / "i"), k=3)
    assert [r.t for r in index["seqs"].orderBy("seq").collect()] == SEQS
    order = suffixes(SEQS)
    assert [tuple(r) for r in programs.nth_located(index["sa"], 7).collect()] == [order[7]]
    reads = spark.createDataFrame([(0, "TTACACCGAA"), (1, "CGTCA"), (2, "GGGG"), (3, "TTTTTT")], "rid long, t string")
    found = programs.find_mems(reads, index, 4)
    got = sorted((r.rid, r.a, r.b, r.bwt_start, r.size) for r in found.collect())
    assert got == sorted((r.rid, *m) for r in reads.collect() for m in mems(SEQS, r.t, 4, 1))
    whole = {r.rid: r for r in programs.query_tags(reads, index).collect()}
    assert set(whole) == {1, 2} and whole[1].hi - whole[1].lo == 1 and whole[1].tags_distinct == 1
    assert programs.mem_lines(found).count() == len(got) and programs.query_lines(programs.query_tags(reads, index)).count() == 2
    assert programs.stat_lines(index).where("line = 'sequences: 3'").count() == 1
    # each component by itself, then merged
    whole_tags = index["tags"].join(index["sa"], "row_id").withColumn("part", F.when(F.col("seq") < 2, "x.tags").otherwise("y.tags"))
    parts = tags.ordinals(whole_tags.select("row_id", "part", "tag"), "part", "row_id").select("part", "ordinal", "tag")
    edges = spark.createDataFrame([(r.u, r.v) for r in programs.graph.edges(index["steps"]).collect()], "u long, v long")
    merged = programs.merge_tags(index, edges, parts)
    assert sorted(map(tuple, merged.collect())) == sorted((r.row_id, r.tag) for r in index["tags"].collect())


def test_from_lines_to_an_index(spark, tmp_path):
    (tmp_path / "s.txt").write_text("GATTAC\n\nAGATAC\n")
    index = programs.build_index(spark, str(tmp_path / "s.txt"), str(tmp_path / "i"))
    assert [(r.seq, r.pos) for r in index["sa"].orderBy("row_id").collect()] == suffixes(["GATTAC", "AGATAC"])
