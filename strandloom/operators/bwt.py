"""Suffix array, Burrows-Wheeler transform, runs, rank and LF as DataFrames.

Rows are numbered from 0; the end of a sequence ('$') is the smallest symbol and ends are ordered by sequence id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.text import chunks
from strandloom.plans.order import as_of, beside, islands, numbered, prefix_sums, stretches
from strandloom.plans.tables import drop, written

SYMBOLS = ("$", "A", "C", "G", "N", "T")
#: Characters of a suffix that the first sort sees; ties go on by doubling.
FIRST = 32


def suffixes(seqs: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq, pos, k, f, c): the first k symbols of every suffix, also of those that end before, its first symbol and the one before it ('$' at the edges)."""
    d = chunks(seqs, k, keep).withColumn("_j", F.explode(F.expr("sequence(0, n - 1)")))
    c = F.when(F.col("_j") == 0, F.col("c")).otherwise(F.expr("substring(x, _j, 1)"))
    d = d.select("seq", *keep, (F.col("base") + F.col("_j")).alias("pos"), F.expr(f"substring(x, _j + 1, {k})").alias("k"), F.expr("substring(x, _j + 1, 1)").alias("f"), c.alias("c"))
    last = F.when(F.length("t") == 0, "$").otherwise(F.expr("right(t, 1)"))
    return d.unionByName(seqs.where("t is not null").select("seq", *keep, F.length("t").cast("long").alias("pos"), F.lit("").alias("k"), F.lit("$").alias("f"), last.alias("c")))


def suffix_array(seqs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, seq, pos, f, c): every suffix of every sequence in order, its first symbol and the one before it.

    The first FIRST characters are sorted; suffixes that still tie are ranked by the rank of the suffix h further on,
    h doubling, so no suffix is ever held as a whole. Ties are found by comparing neighbours in the order, so a passage
    that many sequences share is spread over tasks; rows that are settled are not touched again. Columns of `by` sort
    before the suffixes and are returned too.
    """
    s = suffixes(seqs, FIRST, by).withColumn("ended", F.when(F.length("k") < FIRST, F.col("seq")).otherwise(F.lit(-1).cast("long")))
    cols = ["seq", *by, "pos", "f", "c", "rank"]
    first = numbered(s, [*by, "k", "ended", "seq", "pos"], "row")
    now = stretches(first, "row", {"rank": [*by, "k", "ended"]}).select(*cols, "rank_more")
    settled, rounds, h = [], [first], FIRST
    while True:
        settled.append(now.where("not rank_more").select(*cols))
        tied = now.where("rank_more").select(*cols)
        if tied.isEmpty():
            break
        ranks = reduce(DataFrame.unionByName, [*settled, tied]).select("seq", (F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
        pairs = tied.join(ranks.hint("merge"), ["seq", "pos"])
        pairs = numbered(pairs, ["rank", "next", "seq", "pos"], "row")
        now = stretches(pairs, "row", {"group": ["rank"], "same": ["rank", "next"]})
        now = now.select(*cols[:-1], (F.col("rank") + F.col("same") - F.col("group")).alias("rank"), F.col("same_more").alias("rank_more"))
        rounds.append(pairs)
        h *= 2
    drop(*rounds)
    return reduce(DataFrame.unionByName, settled).select(F.col("rank").cast("long").alias("row_id"), "seq", *by, "pos", "f", "c")


def blocks(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, lo, size, r_$, r_A, ...), written: for the first k symbols of suffixes (fewer where they end), the rows that begin with them, and how often each symbol stands before the first of these rows.

    Suffixes with equal first symbols are neighbours in the order, so counts of each prefix and their running sums are enough;
    no suffix array is needed and what is shuffled is one row for each prefix and task.
    """
    s = suffixes(seqs, k)
    each = s.groupBy(F.col("k").alias("kmer")).agg(F.count("*").alias("size"), *(F.count_if(F.col("c") == x).alias(f"n_{x}") for x in SYMBOLS))
    order = numbered(each, ["kmer"], "_at")
    sums = prefix_sums(order, "_at", {"lo": F.col("size")} | {f"r_{x}": F.col(f"n_{x}") for x in SYMBOLS})
    out = written(sums.select("kmer", "lo", "size", *(f"r_{x}" for x in SYMBOLS)))
    drop(order)
    return out


def bounds(blocks_: DataFrame, seqs: DataFrame) -> DataFrame:
    """(row_id, r_$, r_A, ...): symbols before the first row of each block, and before the row after the last."""
    ends = seqs.where("t is not null").select(F.length("t").cast("long").alias("n"), *(F.length(F.regexp_replace("t", f"[^{x}]", "")).cast("long").alias(f"n_{x}") for x in SYMBOLS[1:]))
    total = ends.agg(F.coalesce(F.sum(F.col("n") + 1), F.lit(0)).alias("row_id"), F.count("*").alias("r_$"), *(F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"r_{x}") for x in SYMBOLS[1:]))
    return blocks_.select(F.col("lo").alias("row_id"), *(f"r_{x}" for x in SYMBOLS)).unionByName(total)


def bwt_runs(sa: DataFrame) -> DataFrame:
    """(run_id, c, start, len); every sequence end is a run of its own."""
    return islands(sa, "row_id", "c", F.col("c") == "$")


def c_array(sa: DataFrame) -> DataFrame:
    """(c, code, cnt, c_before) for the symbols that occur; at most six rows."""
    counts = sa.groupBy("c").agg(F.count("*").alias("cnt"))
    order = Window.orderBy("c")
    return counts.select("c", (F.row_number().over(order) - 1).cast("long").alias("code"), "cnt", F.coalesce(F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("c_before"))


def lf_mapping(sa: DataFrame) -> DataFrame:
    """(row_id, c, lf): the row of the suffix one symbol longer."""
    before = F.broadcast(c_array(sa).select("c", "c_before"))  # at most six rows
    return ranks(sa).join(before, "c").select("row_id", "c", (F.col("c_before") + F.element_at(F.create_map(*[x for s in SYMBOLS for x in (F.lit(s), F.col(f"r_{s}"))]), F.col("c"))).alias("lf"))


def ranks(sa: DataFrame) -> DataFrame:
    """(row_id, c, r_$, r_A, ...): how often each symbol stands before each row."""
    return prefix_sums(sa.select("row_id", "c"), "row_id", {f"r_{s}": F.col("c") == s for s in SYMBOLS})


def block_ranks(runs: DataFrame, size: int = 10) -> DataFrame:
    """(block, start, A, C, G, T, ends): symbol counts before each block of `size` runs."""
    sums = {n: F.when(F.col("c") == s, F.col("len")).otherwise(0) for n, s in (("ends", "$"), *((x, x) for x in "ACGNT"))}
    return prefix_sums(runs, "run_id", sums).where(f"run_id % {size} = 0").select(F.expr(f"run_id div {size}").alias("block"), "start", *sums)


def samples(sa: DataFrame, runs: DataFrame, tail: bool) -> DataFrame:
    """(run_id, seq, pos) of the first or last row of each run."""
    at = runs.select("run_id", (F.col("start") + (F.col("len") - 1 if tail else 0)).alias("row_id"))
    return at.join(sa, "row_id").select("run_id", "seq", "pos")


def locate_next(sa: DataFrame) -> DataFrame:
    """(seq, pos, next_seq, next_pos): the suffix after each suffix in order; the last has none."""
    return beside(sa.select("row_id", "seq", "pos"), "row_id", {"next_seq": "seq", "next_pos": "pos"}, 1).where("next_seq is not null").select("seq", "pos", "next_seq", "next_pos")


def run_of_row(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows (row_id) with the run they lie in and their place in it."""
    found = as_of(rows.select("row_id"), "row_id", runs.select("start", F.struct("run_id", "start").alias("run")), "start", "run")
    return found.select("row_id", F.col("run.run_id").alias("run_id"), (F.col("row_id") - F.col("run.start")).alias("run_offset"))
