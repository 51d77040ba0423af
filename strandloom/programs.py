"""The whole way from files to results: build an index, search it, ask for tags, merge parts, print statistics.

An index is a folder of tables (sources.readers.save_index): seqs, sa, runs, and with a graph nodes, steps, tags and tag_runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import bwt, graph, search, stats, tags
from strandloom.plans.tables import written
from strandloom.sources.readers import load_index, path_sequences, read_gfa, read_lines, save_index


def build_index(spark: SparkSession, lines: str, out: str) -> dict[str, DataFrame]:
    """Index the lines of text files into the folder out."""
    seqs = written(read_lines(spark, lines))
    sa = written(bwt.suffix_array(seqs))
    save_index(out, seqs=seqs, sa=sa, runs=bwt.bwt_runs(sa))
    return load_index(spark, out)


def build_tags(spark: SparkSession, gfa: str, out: str, k: int = 31) -> dict[str, DataFrame]:
    """Index the paths of a graph with the graph position of every row. Positions that k-mers and extension give are checked against those of the paths; one that differs is an error."""
    nodes, _, steps = (written(x) for x in read_gfa(spark, gfa))
    seqs = written(path_sequences(nodes, steps))
    sa = written(bwt.suffix_array(seqs))
    at = written(tags.tag_array(sa, steps))
    reached = graph.extend(sa, graph.covered_rows(seqs, sa, steps, k), steps, nodes)
    if not tags.disagreeing(reached, at).isEmpty():
        raise ValueError("positions by k-mers differ from those of the paths")
    save_index(out, seqs=seqs, sa=sa, runs=bwt.bwt_runs(sa), nodes=nodes, steps=steps, tags=at, tag_runs=tags.tag_runs(at))
    return load_index(spark, out)


def find_mems(reads: DataFrame, index: dict[str, DataFrame], min_len: int, min_occ: int = 1) -> DataFrame:
    """(rid, a, b, bwt_start, size, positions, tags) of reads (rid, t): maximal exact matches, how many graph positions they touch, and these in order."""
    found = written(search.matches(reads, index["seqs"], index["sa"], min_len, min_occ))
    asked = found.withColumn("lo", F.col("bwt_start")).withColumn("hi", F.col("bwt_start") + F.col("size") - 1)
    hits = tags.overlapping(asked, index["tag_runs"])
    return hits.groupBy("rid", "a", "b", "bwt_start", "size").agg(F.countDistinct("tag").alias("positions"), F.array_sort(F.collect_set("tag")).alias("tags"))


def query_tags(reads: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """(rid, len, lo, hi, tags_distinct, runs_logical, runs_physical) of reads (rid, t) that occur as a whole."""
    found = search.count(reads.select(F.col("t").alias("pattern")), index["seqs"], index["sa"])
    asked = written(reads.join(found.hint("merge"), reads["t"] == found["pattern"]).select("rid", F.length("t").cast("long").alias("len"), "lo", "hi"))
    counts = tags.query_tags(asked.select(F.col("rid").alias("qid"), "lo", "hi"), index["tag_runs"])
    return asked.join(counts.withColumnRenamed("qid", "rid").hint("merge"), "rid")


def merge_tags(index: dict[str, DataFrame], edges: DataFrame, part_tags: DataFrame) -> DataFrame:
    """(row_id, tag) of a whole index from the tags (part, ordinal, tag) of its parts: the first tag of a part says which component, and so which sequences, it has."""
    comp = written(graph.components(edges, index["nodes"]))
    return tags.merge(index["sa"], written(tags.owners(part_tags, index["steps"], comp)), part_tags)


def mem_lines(mems: DataFrame) -> DataFrame:
    """(rid, a, line): results as text."""
    line = F.format_string("Seq: %d\tstart %d\tend %d\tfirst row %d\tsize %d\tpositions %d", "rid", "a", "b", "bwt_start", "size", "positions")
    return mems.select("rid", "a", line.alias("line"))


def query_lines(found: DataFrame) -> DataFrame:
    """(rid, line): results as tab-separated text."""
    return found.select("rid", F.concat_ws("\t", "rid", "len", "lo", "hi", "runs_physical").alias("line"))


def stat_lines(index: dict[str, DataFrame]) -> DataFrame:
    """(component, line): counts of an index as text."""
    rows = stats.index_stats(index["seqs"], index["runs"], index["tag_runs"])
    return rows.select("component", F.format_string("%s: %d", "component", "items").alias("line"))


def nth_located(sa: DataFrame, n: int = 0) -> DataFrame:
    """(seq, pos) of the n-th suffix in order, from 0; the first for n = 0, no row past the last."""
    return sa.where(F.col("row_id") == n).select("seq", "pos")
