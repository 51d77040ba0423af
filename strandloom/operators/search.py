"""Counting, locating, bidirectional extension and maximal exact matches as joins on k-mers and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.text import kmers, reverse_complement, windows
from strandloom.operators.bwt import blocks


#: Patterns of up to this many symbols are looked up as prefixes; longer ones by seeds of this length.
SEED = 16


def count_fixed(patterns: DataFrame, held: DataFrame) -> DataFrame:
    """(pattern, lo, hi): closed row ranges of patterns whose length is the k of bwt.blocks(); patterns that don't occur are left out."""
    held = held.select(F.col("kmer").alias("pattern"), "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))
    return patterns.select("pattern").join(held.hint("merge"), "pattern")


def occurrences(patterns: DataFrame, seqs: DataFrame) -> DataFrame:
    """(pattern, seq, pos): where patterns of any length stand. Empty and null patterns stand nowhere; repeated ones count once.

    A pattern of over SEED symbols is cut into seeds, side by side and one at its end; it stands where all of them do. Text and
    patterns meet in equi-joins on words, one for each length up to SEED that patterns have.
    """
    p = patterns.select("pattern").where("pattern <> ''").distinct()
    lengths = sorted(r[0] for r in p.select(F.least(F.length("pattern"), F.lit(SEED)).alias("n")).distinct().collect())  # at most SEED rows
    if not lengths:
        return p.select("pattern", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("pos")).limit(0)
    out = []
    for n in lengths:
        if n < SEED:
            out.append(p.where(F.length("pattern") == n).join(windows(seqs, n).withColumnRenamed("kmer", "pattern").hint("merge"), "pattern").select("pattern", "seq", "pos"))
            continue
        long = p.where(F.length("pattern") >= SEED).withColumn("at", F.explode(F.expr(f"array_distinct(concat(sequence(0, length(pattern) - {SEED}, {SEED}), array(length(pattern) - {SEED})))")))
        seeds = long.select("pattern", "at", F.expr(f"substring(pattern, at + 1, {SEED})").alias("kmer"))
        hits = windows(seqs, SEED).select("seq", "pos", "kmer").hint("merge").join(seeds, "kmer").select("pattern", "seq", (F.col("pos") - F.col("at")).alias("pos"))
        seeds_of = F.ceil(F.length("pattern") / SEED)
        out.append(hits.groupBy("pattern", "seq", "pos").agg(F.count("*").alias("m")).where(F.col("m") == seeds_of).select("pattern", "seq", "pos"))
    return reduce(DataFrame.unionByName, out)


def count(patterns: DataFrame, seqs: DataFrame, sa: DataFrame) -> DataFrame:
    """(pattern, lo, hi): closed row ranges of patterns of any length; patterns that don't occur are left out, repeated ones come once."""
    p = patterns.select("pattern").where("pattern <> ''").distinct()
    short = sorted(r[0] for r in p.where(F.length("pattern") < SEED).select(F.length("pattern").alias("n")).distinct().collect())  # fewer than SEED rows
    at = occurrences(p.where(F.length("pattern") >= SEED), seqs).hint("merge").join(sa.select("seq", "pos", "row_id"), ["seq", "pos"])
    found = [at.groupBy("pattern").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))]
    found += [count_fixed(p.where(F.length("pattern") == n), blocks(seqs, n)) for n in short]
    return reduce(DataFrame.unionByName, found)


def locate(patterns: DataFrame, seqs: DataFrame) -> DataFrame:
    """(pattern, seq): the distinct sequences that have a pattern, of any length."""
    return occurrences(patterns, seqs).select("pattern", "seq").distinct()


def lf_step(ranges: DataFrame, symbol: str, ranks: DataFrame, c_before: DataFrame) -> DataFrame:
    """(pattern, lo, hi): ranges one symbol longer to the left; empty ones are left out."""
    r = ranks.select("row_id", F.col(f"r_{symbol}").alias("r"), (F.col("c") == symbol).cast("int").alias("own"))
    both = ranges.join(r.select(F.col("row_id").alias("lo"), F.col("r").alias("rl")).hint("merge"), "lo").join(r.select(F.col("row_id").alias("hi"), (F.col("r") + F.col("own")).alias("rh")).hint("merge"), "hi")
    both = both.withColumn("c", F.lit(symbol)).join(F.broadcast(c_before.select("c", "c_before")), "c")  # at most six rows
    return both.where("rh > rl").select(F.concat(F.lit(symbol), "pattern").alias("pattern"), (F.col("c_before") + F.col("rl")).alias("lo"), (F.col("c_before") + F.col("rh") - 1).alias("hi"))


def bi_intervals(patterns: DataFrame, held: DataFrame) -> DataFrame:
    """(pattern, k, l, s): first row of a pattern, first row of its reverse complement, and size; held is bwt.blocks() of both strands for this length."""
    found = count_fixed(patterns.select("pattern").unionByName(patterns.select(reverse_complement(F.col("pattern")).alias("pattern"))).distinct(), held)
    other = found.select(F.col("pattern").alias("rc"), F.col("lo").alias("l"))
    return patterns.join(found, "pattern").withColumn("rc", reverse_complement(F.col("pattern"))).join(other, "rc").select("pattern", F.col("lo").alias("k"), "l", (F.col("hi") - F.col("lo") + 1).alias("s"))


_COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}


def backward_extend(intervals: DataFrame, symbols: str, ranks: DataFrame, c_before: DataFrame) -> DataFrame:
    """Bidirectional intervals of symbol + pattern for each of the symbols; empty ones are left out.

    k by rank, s by the rank difference, l by what sorts before the complement. ranks has exclusive counts (r_$, r_A, ...) at
    the rows where intervals begin and the rows after their ends: bwt.bounds() for words of one length, or bwt.ranks()
    with the row after the last. The two rows of an interval are looked up once for all symbols.
    """
    cols = [f"r_{x}" for x in ("$", "A", "C", "G", "N", "T")]
    first = ranks.select(F.col("row_id").alias("k"), *(F.col(c).alias(f"lo_{c}") for c in cols))
    after = ranks.select(F.col("row_id").alias("end"), *(F.col(c).alias(f"hi_{c}") for c in cols))
    d = intervals.withColumn("end", F.col("k") + F.col("s")).join(first.hint("merge"), "k").join(after.hint("merge"), "end")
    size = lambda x: F.col(f"hi_r_{x}") - F.col(f"lo_r_{x}")
    steps = []
    for x in symbols:
        smaller = [_COMPLEMENT[y] for y in ("A", "C", "G", "N", "T") if y < _COMPLEMENT[x]]
        before = size("$") + sum((size(y) for y in smaller), F.lit(0))
        steps.append(F.struct(F.lit(x).alias("c"), F.col(f"lo_r_{x}").alias("r"), (F.col("l") + before).alias("l"), size(x).alias("s")))
    d = d.select("pattern", F.explode(F.array(*steps)).alias("x")).select("pattern", "x.*").where("s > 0")
    d = d.join(F.broadcast(c_before.select("c", "c_before")), "c")  # at most six rows
    return d.select(F.concat("c", "pattern").alias("pattern"), (F.col("c_before") + F.col("r")).alias("k"), "l", "s")


def forward_extend(intervals: DataFrame, symbols: str, ranks: DataFrame, c_before: DataFrame) -> DataFrame:
    """Intervals of pattern + symbol: the reverse complements are extended backward by the complements."""
    turned = intervals.select(reverse_complement(F.col("pattern")).alias("pattern"), F.col("l").alias("k"), F.col("k").alias("l"), "s")
    done = backward_extend(turned, "".join(_COMPLEMENT[x] for x in symbols), ranks, c_before)
    return done.select(reverse_complement(F.col("pattern")).alias("pattern"), F.col("l").alias("k"), F.col("k").alias("l"), "s")


def pair_matches(reads: DataFrame, seqs: DataFrame, min_len: int) -> DataFrame:
    """(rid, seq, dg, a0, b0): maximal exact matches of each read and sequence on a diagonal, at least min_len long."""
    hits = kmers(reads.select(F.col("rid").alias("seq"), "t"), min_len).select(F.col("seq").alias("rid"), F.col("pos").alias("a"), "kmer").join(kmers(seqs, min_len).hint("merge"), "kmer")
    hits = hits.select("rid", "seq", (F.col("a") - F.col("pos")).alias("dg"), "a")
    w = Window.partitionBy("rid", "seq", "dg").orderBy("a")
    return hits.withColumn("g", F.col("a") - F.row_number().over(w)).groupBy("rid", "seq", "dg", "g").agg(F.min("a").alias("a0"), (F.max("a") + min_len).alias("b0")).drop("g")


def matches(reads: DataFrame, seqs: DataFrame, sa: DataFrame, min_len: int, min_occ: int = 1, suffix_mems: bool = False) -> DataFrame:
    """(rid, a, b, bwt_start, size): maximal exact matches [a, b) of reads with at least max(min_occ, 1) occurrences.

    The reach of a start (its min_occ-th farthest end) never falls from start to start, so a match is maximal exactly where
    the reach grows. suffix_mems adds, where a match ends with the read, the shorter suffixes that a search
    which goes on past the end of the read would report too.
    """
    m = max(min_occ, 1)
    pairs = pair_matches(reads, seqs, min_len)
    starts = pairs.select("rid", F.col("b0").alias("b"), F.explode(F.sequence(F.col("a0"), F.col("b0") - min_len)).alias("a"))
    best = Window.partitionBy("rid", "a").orderBy(F.desc("b"))
    reach = starts.withColumn("rn", F.row_number().over(best)).where(F.col("rn") == m).drop("rn")
    along = Window.partitionBy("rid").orderBy("a")
    found = reach.withColumn("pa", F.lag("a").over(along)).withColumn("pb", F.lag("b").over(along)).where("pa is null or pa < a - 1 or pb < b").select("rid", "a", "b")
    if suffix_mems:
        whole = reads.select("rid", F.length("t").cast("long").alias("n"))
        tails = kmers(reads.select(F.col("rid").alias("seq"), "t"), 1).select(F.col("seq").alias("rid")).distinct()
        lcs = _common_suffixes(reads.join(tails, "rid"), seqs)
        nth = Window.partitionBy("rid").orderBy(F.desc("s"))
        s = lcs.withColumn("rn", F.row_number().over(nth)).where(F.col("rn") == m).select("rid", "s")
        ending = found.join(whole, "rid").where("b = n").groupBy("rid", "n").agg(F.min("a").alias("x")).join(s, "rid")
        ending = ending.withColumn("from", F.greatest(F.col("x") + 1, F.col("n") - F.col("s"))).where(F.col("from") <= F.col("n") - min_len)
        found = found.unionByName(ending.select("rid", F.explode(F.sequence("from", F.col("n") - min_len)).alias("a"), F.col("n").alias("b"))).distinct()
    occ = found.join(pairs, "rid").where("a0 <= a and b0 >= b").select("rid", "a", "b", "seq", (F.col("a") - F.col("dg")).alias("pos"))
    return occ.join(sa.select("seq", "pos", "row_id").hint("merge"), ["seq", "pos"]).groupBy("rid", "a", "b").agg(F.min("row_id").alias("bwt_start"), F.count("*").alias("size"))


def _common_suffixes(reads: DataFrame, seqs: DataFrame) -> DataFrame:
    """(rid, seq, s): length of the longest common suffix where it is not 0; candidates share the last symbol."""
    r = reads.select("rid", F.reverse("t").alias("rt"), F.substring(F.reverse("t"), 1, 1).alias("z"))
    q = seqs.select("seq", F.reverse("t").alias("qt"), F.substring(F.reverse("t"), 1, 1).alias("z"))
    upto = F.sequence(F.lit(1), F.least(F.length("rt"), F.length("qt")))
    same = F.size(F.filter(upto, lambda i: F.substring("rt", F.lit(1), i) == F.substring("qt", F.lit(1), i)))
    return r.join(q, "z").where("rt <> '' and qt <> ''").select("rid", "seq", same.cast("long").alias("s"))


#: Suffixes up to this length are looked up as words; longer ones grow from their last TAIL symbols.
TAIL = 12


def longest_suffix(reads: DataFrame, seqs: DataFrame) -> DataFrame:
    """(rid, len): how many last symbols of a read occur somewhere; 0 if none."""
    n = F.explode(F.sequence(F.lit(1), F.least(F.length("t"), F.lit(TAIL))))
    tails = reads.where("t <> ''").select("rid", "t", n.alias("n")).select("rid", "n", F.expr("right(t, n)").alias("w"))
    windows = seqs.where("t <> ''").select("t", n.alias("n")).select("n", "t", F.explode(F.sequence(F.lit(0), F.length("t") - F.col("n"))).alias("p")).select("n", F.expr("substring(t, p + 1, n)").alias("w")).distinct()
    short = tails.join(windows, ["n", "w"], "left_semi").groupBy("rid").agg(F.max("n").cast("long").alias("len"))
    ends = reads.where(F.length("t") >= TAIL).select("rid", F.expr(f"right(t, {TAIL})").alias("kmer"), F.reverse("t").alias("rt"))
    grown = kmers(seqs, TAIL).hint("merge").join(ends, "kmer").join(seqs.hint("merge"), "seq").select("rid", "rt", F.reverse(F.expr(f"substring(t, 1, pos + {TAIL})")).alias("qt"))
    upto = F.sequence(F.lit(TAIL), F.least(F.length("rt"), F.length("qt")))
    same = F.array_max(F.filter(upto, lambda i: F.substring("rt", F.lit(1), i) == F.substring("qt", F.lit(1), i)))
    long = grown.groupBy("rid").agg(F.max(same).cast("long").alias("len"))
    best = short.unionByName(long).groupBy("rid").agg(F.max("len").alias("len"))
    return reads.select("rid").join(best, "rid", "left").select("rid", F.coalesce("len", F.lit(0)).cast("long").alias("len"))
