"""Written tables: a plan is cut by writing it to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table that may be broadcast; larger ones are joined by a sorted merge.
SMALL = 200_000
#: Spark's own setting that deletes the shuffle files of a query as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset, a temporary folder does for a master on this machine; a cluster without one is an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="strandloom-"))
        found = sc.getCheckpointDir()
    return found


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table that is read back, so that nothing before it runs again; the shuffle files it took are deleted."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def beside_large(table: DataFrame) -> DataFrame:
    """A written table as the side of a join with something large: broadcast where its rows have been counted as few, else for a sorted merge.

    File sizes say little about rows here (runs and ids compress well), so they never decide.
    """
    few = table.limit(SMALL + 1).count() <= SMALL
    return F.broadcast(table) if few else table.hint("merge")
