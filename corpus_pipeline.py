"""Corpus pipeline: toxicity, repeated passages, near-duplicates, benchmark contamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last return the
columns of documents, whatever these are called: working columns get free names. Nulls, empty tables and repeated rows are
treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, linededup, minhash, toxicity
from strandloom.llm.common import free_name, table
from strandloom.plans.tables import drop, written as save


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under toxicity.REJECT; the model learns from the labels of these rows.

    Each row is decided by its own text, also where ids are null or repeated; a null text is scored as an empty one.
    """
    model = spark.sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))
    score = free_name(docs, "_score")
    scored = docs.withColumn(score, toxicity.toxicity(F.col("text").cast("string"), model))
    return scored.where(F.col(score) < toxicity.REJECT).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, later repeats of passages cut out of text; n_chars follows. A document that is all repeats stays with ''."""
    cut = free_name(docs, "_cut")
    done = linededup.without_repeats(docs, out=cut).withColumn("text", F.col(cut)["text"])
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) one row; documents without words are in no group and stay.

    It is the row of the smallest doc_id, null ids last, and of that id the text of the smallest hash; of equal rows (one id
    and text) one stays. Each row is decided by its own text, so an id that two texts share can lose one of them and keep
    the other.
    """
    near = minhash.near_duplicates(docs, keyed=True).where("root is not null").groupBy("root", "doc_id", "h").agg(F.count("*").alias("m"))
    near = save(near.withColumn("key", F.struct(F.col("doc_id").isNull(), "doc_id", "h")))
    kept = near.groupBy("root").agg(F.min("key").alias("kept"))
    near = near.join(kept, "root").select("doc_id", "h", "m", (~F.col("key").eqNullSafe(F.col("kept"))).alias("rejected")).where("rejected or m > 1")
    h, id_, nh, out = (free_name(docs, x) for x in ("_h", "_near_id", "_near_h", "_near_out"))
    near = save(near.select(F.col("doc_id").alias(id_), F.col("h").alias(nh), F.col("rejected").alias(out)))
    own = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(nh))
    single = own.join(near.hint("merge"), same, "left_anti")
    repeated = own.join(near.where(~F.col(out)).hint("merge"), same, "left_semi").dropDuplicates(["doc_id", h])
    return single.unionByName(repeated).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated by items of benchmark; each is decided by its own text."""
    hits = free_name(docs, "_hits")
    marked = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), out=hits)
    return marked.where(~decontaminate.contaminated(F.col(hits))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids as little-endian unsigned 32-bit integers, and digests of the ids and of the text they decode to."""
    return bpe.with_bpe(docs).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeats),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encode_decode", encode),
]

#: SQL can't express the first stage, nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = None
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
        drop(kept)  # what the stage before wrote
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
