"""Graph positions of suffix-array rows, their runs, and which of them a row range touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.text import encode_tag, pieces, reverse_complement
from strandloom.plans.order import islands, numbered, prefix_sums, range_join
from strandloom.plans.tables import written

#: Symbols of a bin in which positions and steps meet.
BIN = 32


def chopped_paths(seqs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, label) and path steps of sequences cut into pieces of width, all walked forward."""
    cut = seqs.where("t <> ''").select("seq", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length(t) - 1) div {width}"))).alias("step"))
    return paths_of(cut.select("seq", "step", F.lit(False).alias("is_rev"), (F.col("step") * width).alias("node_start"), F.expr(f"substring(t, step * {width} + 1, {width})").alias("piece")))


def paths_of(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, label) and steps (seq, step, node_id, is_rev, node_start, size) of pieces (seq, step, is_rev, node_start, piece); equal labels are one node."""
    cut = cut.withColumn("label", F.when(F.col("is_rev"), reverse_complement(F.col("piece"))).otherwise(F.col("piece")))
    nodes = written(numbered(cut.select("label").distinct(), ["label"], "n").select((F.col("n") + 1).alias("node_id"), "label"))
    steps = cut.hint("merge").join(nodes, "label").select("seq", "step", "node_id", "is_rev", "node_start", F.length("label").cast("long").alias("size"))
    return nodes, steps


def at_steps(rows: DataFrame, steps: DataFrame, how: str = "inner") -> DataFrame:
    """rows (seq, pos and others) with the columns of the step that holds each position, whatever the lengths of nodes: an equi-join on bins of BIN symbols, where few steps meet.

    Positions that no step holds are left out, or have nulls where how is "left".
    """
    own = steps.withColumn("_bin", F.explode(F.expr(f"sequence(node_start div {BIN}, (node_start + size - 1) div {BIN})"))).withColumnRenamed("seq", "_seq").withColumnRenamed("_bin", "_own")
    d = rows.withColumn("_bin", F.expr(f"pos div {BIN}")).hint("merge")
    return d.join(own, F.expr("seq = _seq and _bin = _own and pos >= node_start and pos < node_start + size"), how).drop("_bin", "_own", "_seq")


def tag_array(sa: DataFrame, steps: DataFrame) -> DataFrame:
    """(row_id, tag): the packed graph position of each row's first symbol; 0 at sequence ends, null where no step of the sequence's path holds the symbol."""
    at = at_steps(sa.where("f <> '$'").select("row_id", "seq", "pos"), steps.select("seq", "node_id", "is_rev", "node_start", "size"), "left")
    tag = encode_tag(F.col("node_id"), F.col("is_rev").cast("long"), F.col("pos") - F.col("node_start"))
    tagged = at.select("row_id", F.when(F.col("node_id").isNotNull(), tag).alias("tag"))
    return tagged.unionByName(sa.where("f = '$'").select("row_id", F.lit(0).cast("long").alias("tag")))


def disagreeing(covered: DataFrame, tags: DataFrame) -> DataFrame:
    """(row_id, tag, path_tag) of rows whose position by k-mers or extension isn't the one their path gives; none in a sound index."""
    own = tags.select("row_id", F.col("tag").alias("path_tag"))
    return covered.select("row_id", "tag").join(own.hint("merge"), "row_id").where("tag <> path_tag")


def tag_runs(tags: DataFrame) -> DataFrame:
    """(run_id, tag, start, len): runs of equal tags."""
    return islands(tags, "row_id", "tag", F.lit(False))


def overlapping(queries: DataFrame, runs: DataFrame, width: int = 256) -> DataFrame:
    """queries (lo, hi and other columns) with every run that touches their closed range."""
    return range_join(queries, "lo", "hi", runs.withColumn("_end", F.col("start") + F.col("len") - 1), "start", "_end", width)


def query_tags(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """(qid, tags_distinct, runs_logical, runs_physical) of the runs that each query's range touches."""
    hits = overlapping(queries, runs)
    return hits.groupBy("qid").agg(F.countDistinct("tag").alias("tags_distinct"), F.count("*").alias("runs_logical"), F.sum(F.expr("(len + 510) div 511")).alias("runs_physical"))


def convert(parts: DataFrame, ends: int) -> DataFrame:
    """Physical runs (ordinal, len, tag) of the rows after the sequence ends as (start, len, tag), with the run of the ends first."""
    first = parts.sparkSession.range(1).select(F.lit(0).cast("long").alias("start"), F.lit(ends).cast("long").alias("len"), F.lit(0).cast("long").alias("tag"))
    return first.unionByName(prefix_sums(parts, "ordinal", {"before": F.col("len")}).select((F.col("before") + ends).alias("start"), "len", "tag"))


def ordinals(rows: DataFrame, part: str, order: str) -> DataFrame:
    """rows with their 0-based place (ordinal) among the rows of their part: places in the order of parts, less the first of each part, so a large part is no single task."""
    d = numbered(rows, [part, order], "_at")
    first = d.groupBy(part).agg(F.min("_at").alias("_first"))
    return d.join(first, part).withColumn("ordinal", F.col("_at") - F.col("_first")).drop("_at", "_first")


def merge(sa: DataFrame, owner: DataFrame, part_tags: DataFrame) -> DataFrame:
    """(row_id, tag) of the whole collection from the tags of its parts.

    owner has (seq, part); part_tags has (part, ordinal, tag), the tags of a part in its own row order. Rows of a part keep
    their order in the whole, so the n-th row of a part takes its n-th tag: an equi-join on (part, ordinal).
    """
    rows = ordinals(sa.select("row_id", "seq").hint("merge").join(owner, "seq").select("row_id", "part"), "part", "row_id")
    return rows.hint("merge").join(part_tags, ["part", "ordinal"]).select("row_id", "tag")


def owners(part_tags: DataFrame, steps: DataFrame, node_component: DataFrame) -> DataFrame:
    """(seq, part): the part a sequence belongs to. The first tag of a part that isn't 0 names a node, the node's component is the part's,
    and a sequence goes with the component of its first node."""
    first = part_tags.where("tag <> 0").groupBy("part").agg(F.min_by("tag", "ordinal").alias("tag"))
    comp = node_component.hint("merge")
    parts = first.select("part", F.shiftright("tag", 11).alias("node_id")).join(comp, "node_id").select("part", "comp")
    return steps.where("step = 0").select("seq", "node_id").join(comp, "node_id").join(parts, "comp").select("seq", "part")


def physical(runs: DataFrame) -> DataFrame:
    """Pieces of at most 511 rows of the runs that are no gaps."""
    return pieces(runs.where("tag <> 0"))
