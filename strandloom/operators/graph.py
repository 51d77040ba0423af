"""k-mers with one graph position, coverage, extension through single predecessors, components.

Steps are (seq, step, node_id, is_rev, node_start, size): nodes of any length, walked in either direction. A position is
packed from the node, the direction it is walked in and the offset in that direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.text import CHUNK, chunks, complement, encode_tag, reverse_complement
from strandloom.operators.bwt import blocks
from strandloom.operators.tags import at_steps
from strandloom.plans.components import connected_components
from strandloom.plans.order import beside, numbered, prefix_sums
from strandloom.plans.tables import drop, written


def tagged_kmers(seqs: DataFrame, steps: DataFrame, k: int, both: bool = False) -> DataFrame:
    """(seq, pos, kmer, tag) of every window of k bases: pos and tag of its first base. With both also the reverse complements by their
    first base, which is the window's last, on the flipped node: there the offset counts from the node's other end.

    Chunks of text meet the steps that have symbols in them, so what is dealt out is a row for each chunk and step, not for each symbol.
    """
    own = steps.select("seq", "node_id", "is_rev", "node_start", "size", F.explode(F.expr(f"sequence(node_start div {CHUNK}, (node_start + size - 1) div {CHUNK})")).alias("chunk"))
    on = chunks(seqs, k - 1, behind=k - 1 if both else 0).withColumn("chunk", F.expr(f"base div {CHUNK}")).hint("merge").join(own, ["seq", "chunk"])
    on = on.where("base < node_start + size and node_start < base + n").withColumn("pos", F.explode(F.expr("sequence(greatest(base, node_start), least(base + n, node_start + size) - 1)")))
    j, offset = F.expr("cast(pos - base as int) + lead + 1"), F.col("pos") - F.col("node_start")
    found = [(F.substring("x", j, F.lit(k)), F.col("is_rev"), offset)]
    if both:
        found.append((reverse_complement(F.substring("x", F.greatest(j - (k - 1), F.lit(1)), F.least(j, F.lit(k)))), ~F.col("is_rev"), F.col("size") - 1 - offset))
    each = F.array(*(F.struct(word.alias("kmer"), encode_tag(F.col("node_id"), rev.cast("long"), at).alias("tag")) for word, rev, at in found))
    on = on.select("seq", "pos", F.explode(each).alias("w")).select("seq", "pos", "w.kmer", "w.tag")
    return on.where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}\\z"))


def unique_kmers(seqs: DataFrame, steps: DataFrame, k: int, both: bool = False) -> DataFrame:
    """(kmer, tag) of k-mers that stand at exactly one graph position; both strands if asked for."""
    at = tagged_kmers(seqs, steps, k, both)
    return at.groupBy("kmer").agg(F.min("tag").alias("tag"), F.max("tag").alias("_hi")).where("tag = _hi").drop("_hi")


def kmer_intervals(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, lo, size): rows whose suffixes begin with each k-mer."""
    return blocks(seqs, k).where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}\\z")).select("kmer", "lo", "size")


def covered_rows(seqs: DataFrame, sa: DataFrame, steps: DataFrame, k: int) -> DataFrame:
    """(row_id, seq, pos, tag) of rows whose position a unique k-mer gives."""
    at = tagged_kmers(seqs, steps, k)
    unique = unique_kmers(seqs, steps, k).select("kmer").hint("merge")
    return at.join(unique, "kmer").select("seq", "pos", "tag").hint("merge").join(sa.select("seq", "pos", "row_id"), ["seq", "pos"]).select("row_id", "seq", "pos", "tag")


def edges(steps: DataFrame) -> DataFrame:
    """(u, u_rev, v, v_rev): distinct neighbours along paths, as they are walked."""
    nxt = steps.select("seq", (F.col("step") - 1).alias("step"), F.col("node_id").alias("v"), F.col("is_rev").alias("v_rev"))
    return steps.select("seq", "step", F.col("node_id").alias("u"), F.col("is_rev").alias("u_rev")).join(nxt.hint("merge"), ["seq", "step"]).select("u", "u_rev", "v", "v_rev").distinct()


def unique_predecessors(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, is_rev, base, pred, pred_rev): for a node in a direction and a base, the predecessor if just one ends in it. Every edge counts in both directions."""
    turned = edges_.select(F.col("v").alias("u"), (~F.col("v_rev")).alias("u_rev"), F.col("u").alias("v"), (~F.col("u_rev")).alias("v_rev"))
    both = edges_.select("u", "u_rev", "v", "v_rev").unionByName(turned).distinct()
    last = nodes.select(F.col("node_id").alias("u"), F.expr("right(label, 1)").alias("_ahead"), complement(F.expr("left(label, 1)")).alias("_back"))
    ends = both.join(last.hint("merge"), "u").withColumn("base", F.when(F.col("u_rev"), F.col("_back")).otherwise(F.col("_ahead")))
    one = ends.groupBy(F.col("v").alias("node_id"), F.col("v_rev").alias("is_rev"), "base").agg(F.min("u").alias("pred"), F.min("u_rev").alias("pred_rev"), F.count("*").alias("n"))
    return one.where("n = 1").drop("n")


def extend(sa: DataFrame, covered: DataFrame, steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row_id, seq, pos, tag) of covered rows and those reached from them to the left: inside a node always, across an edge where the base has one predecessor.

    Along a path the node before is the one predecessor or there is none, so a path falls into stretches of steps whose edges can be
    crossed, and what is reached is every position of a stretch up to its last covered one: running sums and one maximum, whatever the length of a stretch.
    """
    order = numbered(steps.select("seq", "step", "node_id", "is_rev", "node_start", "size"), ["seq", "step"], "at")
    last = nodes.select("node_id", F.expr("right(label, 1)").alias("_ahead"), complement(F.expr("left(label, 1)")).alias("_back"))
    d = order.join(last.hint("merge"), "node_id").withColumn("_end", F.when(F.col("is_rev"), F.col("_back")).otherwise(F.col("_ahead"))).drop("_ahead", "_back")
    d = beside(d, "at", {"base": "_end", "_seq": "seq"}).withColumn("base", F.when(F.col("_seq") == F.col("seq"), F.col("base")))
    d = d.join(unique_predecessors(edges(steps), nodes).select("node_id", "is_rev", "base", "pred").hint("merge"), ["node_id", "is_rev", "base"], "left")
    d = prefix_sums(d.select("at", "seq", "node_id", "is_rev", "node_start", "size", F.col("pred").isNull().cast("long").alias("_first")), "at", {"_before": F.col("_first")})
    d = written(d.withColumn("stretch", F.col("_before") + F.col("_first")).drop("_before", "_first"))
    drop(order)
    reached = at_steps(covered.select("seq", "pos"), d).groupBy("stretch").agg(F.max("pos").alias("_upto"))
    d = d.join(reached.hint("merge"), "stretch").where("node_start <= _upto")
    d = d.withColumn("pos", F.explode(F.expr("sequence(node_start, least(_upto, node_start + size - 1))")))
    d = d.select("seq", "pos", encode_tag(F.col("node_id"), F.col("is_rev").cast("long"), F.col("pos") - F.col("node_start")).alias("tag"))
    return d.hint("merge").join(sa.select("seq", "pos", "row_id"), ["seq", "pos"]).select("row_id", "seq", "pos", "tag")


def components(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, comp): the smallest node id of each weakly connected component."""
    roots = connected_components(edges_.select("u", "v"))
    return nodes.select("node_id").join(roots.withColumnRenamed("node", "node_id").hint("merge"), "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("comp"))
