"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.tables import drop, written

#: Edges that one task contracts to a forest.
TASK_EDGES = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of a task's edges that isn't the least of its tree, and that least node."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if kind is not None:
        pairs = [(x, root(x)) for x in up]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind.field(k).type) for k in (0, 1)], schema=kind)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that isn't the smallest of its component; edges are (u, v) of one orderable type.

    First each task contracts at most TASK_EDGES edges to a forest; where that takes one task, it is the answer.
    Otherwise large-star and small-star steps follow: group-by minima and equi-joins, so a hub's neighbours are dealt over
    tasks by the skew join; nothing is collected. Loops and null ends count for nothing; an empty input gives an empty
    result. Each round is written to the shared folder, and the one before it deleted.
    """
    plain = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tasks = -(-plain.count() // TASK_EDGES)
    state = written((plain if tasks < 2 else plain.repartition(tasks)).coalesce(max(1, tasks)).mapInArrow(_forest, plain.schema))
    drop(plain)
    if tasks < 2:
        return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = _digest(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop(large)
        now = _digest(nxt)
        drop(state)
        state = nxt
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
