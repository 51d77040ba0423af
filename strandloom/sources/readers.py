"""Sequences, reads and graphs from text files and tables; indexes as folders of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.text import reverse_complement
from strandloom.plans.order import numbered, prefix_sums
from strandloom.plans.tables import written

FORMAT_VERSION = 1


def read_lines(spark: SparkSession, path: str, name: str = "seq") -> DataFrame:
    """(name, t): the lines of text files that aren't empty, numbered from 0 in file order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("t"))
    return numbered(written(lines).where(F.length("t") > 0), ["f", "b", "i"], name).select(name, "t")


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (node_id, name, label), edges (u, u_rev, v, v_rev) and path steps (seq, step, node_id, is_rev, node_start, size) of GFA 1 text.

    Paths are P and W lines, numbered by name (of a W line: sample, haplotype, sequence and start). Where every segment name is a number
    it is the node's id, else ids are places in the order of names, from 1.
    """
    cols = F.split("value", "\t")
    lines = spark.read.text(path).select(cols.alias("x"), F.col("value"))
    named = written(lines.where("x[0] = 'S'").select(F.col("x")[1].alias("name"), F.col("x")[2].alias("label")))
    if named.where(~F.col("name").rlike("^[0-9]{1,15}$")).isEmpty():
        nodes = named.select(F.col("name").cast("long").alias("node_id"), "name", "label")
    else:
        nodes = written(numbered(named, ["name"], "n").select((F.col("n") + 1).alias("node_id"), "name", "label"))
    ids = nodes.select("name", "node_id")
    links = lines.where("x[0] = 'L'").select(F.col("x")[1].alias("un"), (F.col("x")[2] == "-").alias("u_rev"), F.col("x")[3].alias("vn"), (F.col("x")[4] == "-").alias("v_rev"))
    edges = links.join(ids.select(F.col("name").alias("un"), F.col("node_id").alias("u")).hint("merge"), "un").join(ids.select(F.col("name").alias("vn"), F.col("node_id").alias("v")).hint("merge"), "vn").select("u", "u_rev", "v", "v_rev")
    p = lines.where("x[0] = 'P'").select(F.col("x")[1].alias("path"), F.transform(F.split(F.col("x")[2], ","), lambda w: F.struct(w.substr(F.lit(1), F.length(w) - 1).alias("name"), w.endswith("-").alias("is_rev"))).alias("walk"))
    w = lines.where("x[0] = 'W'").select(F.concat_ws("#", F.col("x")[1], F.col("x")[2], F.col("x")[3], F.col("x")[4]).alias("path"), F.transform(F.regexp_extract_all(F.col("x")[6], F.lit("[<>][^<>]+"), 0), lambda w: F.struct(w.substr(F.lit(2), F.length(w)).alias("name"), w.startswith("<").alias("is_rev"))).alias("walk"))
    paths = numbered(p.unionByName(w), ["path"], "seq")
    steps = paths.select("seq", F.posexplode("walk").alias("step", "w")).select("seq", F.col("step").cast("long").alias("step"), "w.name", "w.is_rev")
    sized = steps.join(nodes.select("name", "node_id", F.length("label").cast("long").alias("size")).hint("merge"), "name").drop("name")
    order = prefix_sums(numbered(sized, ["seq", "step"], "_at"), "_at", {"_before": F.col("size")})
    first = order.where("step = 0").select("seq", F.col("_before").alias("_first"))
    return nodes, edges, order.join(first, "seq").select("seq", "step", "node_id", "is_rev", (F.col("_before") - F.col("_first")).alias("node_start"), "size")


def path_sequences(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(seq, t): what the paths spell."""
    d = steps.join(nodes, "node_id").select("seq", "step", F.when(F.col("is_rev"), reverse_complement(F.col("label"))).otherwise(F.col("label")).alias("x"))
    return d.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("step", "x"))).alias("xs")).select("seq", F.array_join(F.col("xs.x"), "").alias("t"))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the regular files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def save_index(path: str, **tables: DataFrame) -> None:
    """Each table as Parquet in a folder of its own, and a meta table with the format's version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(FORMAT_VERSION, ",".join(sorted(tables)))], "version int, tables string").write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index; another version is refused."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != FORMAT_VERSION:
        raise ValueError(f"index version {meta['version']}, not {FORMAT_VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"].split(",")}
