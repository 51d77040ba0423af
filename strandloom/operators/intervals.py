"""The interval map in bulk: union of tagged intervals, floor lookups, gap filling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.order import as_of


def interval_union(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Closed intervals (start, end) of each group, overlapping or touching ones joined. The groups keep their windows apart."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    top = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = intervals.withColumn("_new", (top.isNull() | (F.col("start") > top + 1)).cast("int"))
    d = d.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def overlaps(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Intervals that an insertion in the order of (start, end) rejects: they begin inside an accepted one of their group.

    What is accepted depends on all before it, so each group is one pass in order; only its last accepted end is held.
    """
    at = [intervals.columns.index(c) for c in by]
    start, end = intervals.columns.index("start"), intervals.columns.index("end")

    def rejected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, top = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in at))) if at else [()] * len(batch)
            out = []
            for key, a, b in zip(keys, batch.column(start).to_pylist(), batch.column(end).to_pylist()):
                if key != group:
                    group, top = key, None
                out.append(top is not None and a <= top)
                if not out[-1]:
                    top = b
            yield batch.filter(pa.array(out, pa.bool_()))

    dealt = intervals.where("start is not null and end is not null")
    dealt = (dealt.repartition(*by) if by else dealt.coalesce(1)).sortWithinPartitions(*by, "start", "end")
    return dealt.mapInArrow(rejected, intervals.schema)


def floor_lookup(probes: DataFrame, key: str, runs: DataFrame) -> DataFrame:
    """probes with the tag of the run that covers key; 0 where none does."""
    found = as_of(probes, key, runs.select("start", F.struct("start", "len", "tag").alias("run")), "start", "run")
    inside = (F.col("run").isNotNull()) & (F.col(key) < F.col("run.start") + F.col("run.len"))
    return found.withColumn("tag", F.when(inside, F.col("run.tag")).otherwise(F.lit(0).cast("long"))).drop("run")


def gap_fill(covered: DataFrame, everything: DataFrame) -> DataFrame:
    """covered (row_id, tag) and, for rows it lacks, the rows of everything."""
    return covered.select("row_id", "tag").unionByName(everything.select("row_id", "tag").join(covered.select("row_id"), "row_id", "left_anti"))
