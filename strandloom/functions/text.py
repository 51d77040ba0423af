"""Column functions on sequences over A, C, G, T and N, and on packed graph positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.plans.order import partitions

#: Longest run of a physical piece, and the bits of a packed position: offset 10, strand 1, length 9.
MAX_PIECE = 511


def complement(t: Column) -> Column:
    """A with T and C with G, both cases; every other character stays."""
    return F.translate(t, "ACGTacgt", "TGCAtgca")


def reverse_complement(t: Column) -> Column:
    return F.reverse(complement(t))


def to_dna(t: Column) -> Column:
    """Letters and digits of a text, taken as A, C, G, T in turn."""
    kept = F.regexp_replace(F.lower(t), "[^a-z0-9]", "")
    return F.translate(kept, "abcdefghijklmnopqrstuvwxyz0123456789", "ACGTACGTACGTACGTACGTACGTACACGTACGTAC")


def pack(seq: Column, pos: Column, max_length: Column | int) -> Column:
    return seq * F.lit(max_length) + pos


def unpack(packed: str, max_length: int) -> tuple[Column, Column]:
    return F.expr(f"{packed} div {max_length}"), F.expr(f"{packed} % {max_length}")


def encode_tag(node: Column, rev: Column, offset: Column) -> Column:
    """node << 11 | rev << 10 | offset; an offset of 1024 or more fails."""
    ok = F.assert_true(offset < 1024, "offset does not fit in 10 bits")
    return F.when(ok.isNull(), F.shiftleft(node.cast("long"), 11).bitwiseOR(F.shiftleft(rev.cast("long"), 10)).bitwiseOR(offset.cast("long")))


def decode_tag(tag: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(tag, 11), F.shiftright(tag, 10).bitwiseAND(F.lit(1).cast("long")), tag.bitwiseAND(F.lit(1023).cast("long"))


def encode_tag_run(node: Column, rev: Column, offset: Column, length: Column) -> Column:
    """node << 20 | length << 11 | rev << 10 | offset."""
    return F.shiftleft(node.cast("long"), 20).bitwiseOR(F.shiftleft(length.cast("long"), 11)).bitwiseOR(F.shiftleft(rev.cast("long"), 10)).bitwiseOR(offset.cast("long"))


def decode_tag_run(v: Column) -> tuple[Column, Column, Column, Column]:
    return F.shiftright(v, 20), F.shiftright(v, 10).bitwiseAND(F.lit(1).cast("long")), v.bitwiseAND(F.lit(1023).cast("long")), F.shiftright(v, 11).bitwiseAND(F.lit(511).cast("long"))


#: Symbols of a chunk of a sequence.
CHUNK = 256


def chunks(seqs: DataFrame, ahead: int, keep: tuple[str, ...] = (), behind: int = 0) -> DataFrame:
    """(seq, base, n, lead, x, c): sequences cut into chunks of CHUNK symbols, dealt out evenly.

    x has up to `behind` symbols before base (lead of them), the n symbols from base on and up to `ahead` more; c is the symbol
    before base ('$' at the beginning). Positions are looked up in a chunk, so a long sequence costs no more than short ones.
    """
    d = seqs.where(F.length("t") > 0).select("seq", *keep, F.expr(f"regexp_extract_all(t, '(?s).{{1,{CHUNK}}}', 0)").alias("_a"))
    d = d.select("*", F.posexplode("_a").alias("_i", "_x"))
    m = max(1, -(-ahead // CHUNK))
    more = F.expr(f"substring(array_join(slice(_a, _i + 2, {m}), ''), 1, {ahead})")
    m = max(1, -(-behind // CHUNK))
    before = F.expr(f"right(array_join(slice(_a, greatest(_i + 1 - {m}, 1), least(_i, {m})), ''), {behind})") if behind else F.lit("")
    d = d.select(
        "seq", *keep, (F.col("_i").cast("long") * CHUNK).alias("base"), F.length("_x").alias("n"), F.length(before).alias("lead"), F.concat(before, "_x", more).alias("x"),
        F.when(F.col("_i") == 0, "$").otherwise(F.expr("right(element_at(_a, greatest(_i, 1)), 1)")).alias("c"),
    )
    return d.repartition(partitions(seqs), "seq", "base")


def windows(seqs: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq, pos, kmer, c): every window of exactly k symbols and the symbol before it ('$' at the beginning)."""
    d = chunks(seqs, k - 1, keep).where(F.length("x") >= k).withColumn("_j", F.explode(F.expr(f"sequence(0, least(n, length(x) - {k - 1}) - 1)")))
    c = F.when(F.col("_j") == 0, F.col("c")).otherwise(F.expr("substring(x, _j, 1)"))
    return d.select("seq", *keep, (F.col("base") + F.col("_j")).alias("pos"), F.expr(f"substring(x, _j + 1, {k})").alias("kmer"), c.alias("c"))


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(seq, pos, kmer) of every window of k bases; a window with another character is left out."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return windows(seqs, k).select("seq", "pos", "kmer").where(F.col("kmer").rlike(r"^[ACGT]+\z"))


def kmers_both(seqs: DataFrame, k: int) -> DataFrame:
    """(seq, pos, is_rev, kmer): both strands; a reverse k-mer is placed at its last base on the forward strand."""
    ahead = kmers(seqs, k)
    return ahead.select("seq", "pos", F.lit(False).alias("is_rev"), "kmer").unionByName(ahead.select("seq", (F.col("pos") + k - 1).alias("pos"), F.lit(True).alias("is_rev"), reverse_complement(F.col("kmer")).alias("kmer")))


def pieces(runs: DataFrame) -> DataFrame:
    """Tag runs cut into pieces of at most MAX_PIECE rows: start, len, tag."""
    d = runs.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(len + {MAX_PIECE - 1}) div {MAX_PIECE} - 1"))))
    return d.select((F.col("start") + MAX_PIECE * F.col("p")).alias("start"), F.least(F.lit(MAX_PIECE).cast("long"), F.col("len") - MAX_PIECE * F.col("p")).alias("len"), "tag")
