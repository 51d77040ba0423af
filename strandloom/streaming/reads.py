"""Reads that arrive as a stream of text files: exact seeds against an index, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """(t, file): lines that aren't empty, as files come."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).where(F.length("value") > 0).select(F.col("value").alias("t"), F.col("_metadata.file_path").alias("file"))


def seed_hits(reads: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(t, a, lo, size): every k-mer of a read with its row range; seeds is kmer_intervals(), a static table."""
    at = reads.where(F.length("t") >= k).withColumn("a", F.explode(F.sequence(F.lit(0), F.length("t") - k))).withColumn("kmer", F.expr(f"substring(t, a + 1, {k})"))
    return at.join(seeds, "kmer").select("t", F.col("a").cast("long").alias("a"), "lo", "size")
