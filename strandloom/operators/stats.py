"""Statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stats(seqs: DataFrame, runs: DataFrame, tag_runs: DataFrame) -> DataFrame:
    """(component, items): rows, sequences, longest sequence and one, runs, tag runs without gaps, physical pieces."""
    one = lambda df, name, c: df.agg(c.cast("long").alias("items")).select(F.lit(name).alias("component"), "items")
    out = one(seqs, "rows", F.coalesce(F.sum(F.length("t") + 1), F.lit(0)))
    for part in (
        one(seqs, "sequences", F.count("*")),
        one(seqs, "max_length", F.coalesce(F.max(F.length("t")) + 1, F.lit(0))),
        one(runs, "runs", F.count("*")),
        one(tag_runs.where("tag <> 0"), "tag_runs", F.count("*")),
        one(tag_runs.where("tag <> 0"), "tag_pieces", F.coalesce(F.sum(F.expr("(len + 510) div 511")), F.lit(0))),
    ):
        out = out.unionByName(part)
    return out


def runs_per_part(tag_runs: DataFrame) -> DataFrame:
    """(part, runs): tag runs in each part."""
    return tag_runs.groupBy("part").agg(F.count("*").alias("runs"))


def bits_per_run(files_bytes: int, runs: int) -> float:
    return 8.0 * files_bytes / runs if runs else 0.0
