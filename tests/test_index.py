import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import text as tx
from strandloom.operators import bwt, graph, intervals, search, tags
from strandloom.plans.order import as_of, numbered, range_join
from tests.brute import bwt as brute_bwt
from tests.brute import mems, occurrences, suffixes

# Golden fixtures: two and five short sequences, and a pair closed under reverse complement.
SMALL = ["GATTAC", "AGATAC"]
CLOSED = ["GATTAGATACAT", "ATGTATCTAATC"]


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq long, t string")


def sa_rows(df):
    return [(r.seq, r.pos) for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize(
    ("seqs", "golden", "array"),
    [(SMALL, "CCTT$GGAAA$TAA", "0 1 0 1 1 1 0 0 1 1 0 0 1 0"), (CLOSED, "TCTTTCGAT$GTATA$TACATGAAAA", "0 1 1 0 0 0 0 1 1 1 0 1 0 1 0 0 1 0 1 0 0 1 1 1 1 0")],
)
def test_golden_transform(spark, seqs, golden, array):
    sa = bwt.suffix_array(frame(spark, seqs)).cache()
    assert "".join(r.c for r in sa.orderBy("row_id").collect()) == golden == brute_bwt(seqs)
    assert " ".join(str(s) for s, _ in sa_rows(sa)) == array
    runs = bwt.bwt_runs(sa).orderBy("run_id").collect()
    assert "".join(r.c * r.len for r in runs) == golden
    assert all(r.len == 1 for r in runs if r.c == "$")
    assert sum(r.len for r in runs) == len(golden)


def test_long_repeats_go_on_by_doubling(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(150))
    seqs = [base, base, base[:100], "A" * 120, "A" * 90 + "C", ""]
    assert sa_rows(bwt.suffix_array(frame(spark, seqs))) == suffixes(seqs)


def test_lf_and_rank(spark):
    sa = bwt.suffix_array(frame(spark, CLOSED)).cache()
    order = suffixes(CLOSED)
    where = {x: k for k, x in enumerate(order)}
    for r in bwt.lf_mapping(sa).collect():
        s, p = order[r.row_id]
        if p:
            assert r.lf == where[s, p - 1]
    text = brute_bwt(CLOSED)
    for r in bwt.ranks(sa).collect():
        assert [r[f"r_{x}"] for x in bwt.SYMBOLS] == [text[: r.row_id].count(x) for x in bwt.SYMBOLS]
    nxt = {(r.seq, r.pos): (r.next_seq, r.next_pos) for r in bwt.locate_next(sa).collect()}
    assert [nxt[x] for x in order[:-1]] == order[1:]


def test_count_locate_and_extension(spark):
    k = 3
    f, sa = frame(spark, CLOSED), bwt.suffix_array(frame(spark, CLOSED)).cache()
    words = sorted({t[i : i + k] for t in CLOSED for i in range(len(t) - k + 1)} | {"CCC"})
    patterns = spark.createDataFrame([(w,) for w in words], "pattern string")
    order = suffixes(CLOSED)
    want = {w: [i for i, (s, p) in enumerate(order) if CLOSED[s].startswith(w, p) and len(CLOSED[s]) - p >= k] for w in words}
    held = bwt.blocks(f, k)
    for got in (search.count_fixed(patterns, held), search.count(patterns, f, sa)):
        assert {r.pattern: (r.lo, r.hi) for r in got.collect()} == {w: (min(x), max(x)) for w, x in want.items() if x}
    at = search.bi_intervals(patterns, held).cache()
    ranks, c = bwt.bounds(held, f).cache(), bwt.c_array(sa).cache()
    full = {r.row_id: tuple(r[f"r_{x}"] for x in bwt.SYMBOLS) for r in bwt.ranks(sa).collect()}
    assert all(full.get(r.row_id, tuple(r)[1:]) == tuple(r[f"r_{x}"] for x in bwt.SYMBOLS) for r in ranks.collect())
    rows = {w: [i for i, (s, p) in enumerate(order) if CLOSED[s][p : p + len(w)] == w] for w in {x + y for x in words for y in "ACGT"} | {y + x for x in words for y in "ACGT"}}
    turn = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for grown in (search.backward_extend, search.forward_extend):
        for r in grown(at, "ACGT", ranks, c).collect():
            assert (r.k, r.s) == (min(rows[r.pattern]), len(rows[r.pattern]))
            assert r.l == min(i for i, (q, p) in enumerate(order) if CLOSED[q][p : p + k + 1] == turn(r.pattern))


@pytest.mark.parametrize("m", [1, 2, 3])
def test_matches_against_brute_force(spark, m):
    rng = random.Random(m)
    seqs = ["".join(rng.choice("ACG") for _ in range(25)) for _ in range(4)]
    reads = ["".join(rng.choice("ACG") for _ in range(14)) for _ in range(5)] + [seqs[0][3:15], ""]
    r = spark.createDataFrame(list(enumerate(reads)), "rid long, t string")
    got = search.matches(r, frame(spark, seqs), bwt.suffix_array(frame(spark, seqs)), 3, m).collect()
    assert sorted(map(tuple, got)) == sorted((i, *x) for i, t in enumerate(reads) for x in mems(seqs, t, 3, m))


def test_suffix_matches_mode(spark):
    seqs = ["ATTGGTGACGAAAGG", "TGTAAGTAGCTGGCCGCCGAGATA", "GCTGAGCGGCGAACCACTAGAAAAGGTTCA"]
    read = "TGAGCGGCGAACCACTAGAAAAGGTTCA"
    r, f = spark.createDataFrame([(0, read)], "rid long, t string"), frame(spark, seqs)
    sa = bwt.suffix_array(f).cache()
    strict = search.matches(r, f, sa, 2).collect()
    assert [tuple(x) for x in strict] == [(0, 0, 28, 66, 1)]
    assert sorted(x.a for x in search.matches(r, f, sa, 2, suffix_mems=True).collect()) == list(range(27))


def test_longest_suffix(spark):
    seqs, reads = ["ACGTACGTACGTACGT", "TTTT"], ["GGGACGTACGTACGTA", "CCT", "", "N", "TTTTT"]
    want = [max((n for n in range(1, len(t) + 1) if occurrences(seqs, t[-n:])), default=0) for t in reads]
    got = search.longest_suffix(spark.createDataFrame(list(enumerate(reads)), "rid long, t string"), frame(spark, seqs)).orderBy("rid").collect()
    assert [r.len for r in got] == want


def test_tags_tile_rows_and_split(spark):
    f = frame(spark, CLOSED)
    sa = bwt.suffix_array(f).cache()
    nodes, steps = tags.chopped_paths(f, 4)
    runs = tags.tag_runs(tags.tag_array(sa, steps)).orderBy("start").collect()
    assert runs[0].tag == 0 and runs[0].start == 0
    assert [r.start + r.len for r in runs[:-1]] == [r.start for r in runs[1:]]
    for n, want in ((511, [511]), (512, [511, 1]), (1022, [511, 511]), (1023, [511, 511, 1])):
        cut = tx.pieces(spark.createDataFrame([(7, n, 9)], "start long, len long, tag long")).orderBy("start").collect()
        assert [x.len for x in cut] == want and [x.start for x in cut] == [7 + 511 * k for k in range(len(want))]


def test_rows_that_no_step_holds_keep_a_null_tag(spark):
    f = frame(spark, ["ACGTAC"])
    steps = spark.createDataFrame([(0, 0, 1, False, 0, 2), (0, 1, 2, False, 4, 1)], "seq long, step long, node_id long, is_rev boolean, node_start long, size long")
    sa = bwt.suffix_array(f).cache()
    at = tags.tag_array(sa, steps)
    got = {r.pos: r.tag for r in at.join(sa, "row_id").collect()}
    assert got == {0: 1 << 11, 1: 1 << 11 | 1, 2: None, 3: None, 4: 2 << 11, 5: None, 6: 0}
    runs = tags.tag_runs(at).orderBy("start").collect()
    assert sum(r.len for r in runs) == 7 and [r.start + r.len for r in runs[:-1]] == [r.start for r in runs[1:]]


def test_tag_codec(spark):
    d = spark.range(1).select(tx.encode_tag(F.lit(5), F.lit(1), F.lit(7)).alias("tag"))
    assert d.first().tag == 11271
    assert tuple(d.select(*tx.decode_tag(F.col("tag"))).first()) == (5, 1, 7)
    v = spark.range(1).select(tx.encode_tag_run(F.lit(5), F.lit(1), F.lit(7), F.lit(300)).alias("v"))
    assert tuple(v.select(*tx.decode_tag_run(F.col("v"))).first()) == (5, 1, 7, 300)
    with pytest.raises(Exception, match="10 bits"):
        spark.range(1).select(tx.encode_tag(F.lit(5), F.lit(1), F.lit(1024))).collect()


def test_overlap_join_equals_the_plain_condition(spark):
    rng = random.Random(1)
    left = [(i, a, a + rng.randrange(60)) for i in range(60) for a in [rng.randrange(500)]]
    right = [(i, a, a + rng.randrange(90)) for i in range(60) for a in [rng.randrange(500)]]
    got = range_join(spark.createDataFrame(left, "i long, lo long, hi long"), "lo", "hi", spark.createDataFrame(right, "j long, start long, stop long"), "start", "stop", 32).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, a, b in left for j, c, d in right if c <= b and d >= a)


def test_numbering_and_as_of(spark):
    d = spark.createDataFrame([(x * 7919 % 997,) for x in range(500)], "v long")
    assert [r.n for r in numbered(d, ["v"], "n").orderBy("v").collect()] == list(range(500))
    starts = spark.createDataFrame([(10, "a"), (70, "b"), (75, "c")], "s long, name string")
    got = as_of(spark.createDataFrame([(k,) for k in (0, 10, 69, 70, 74, 500)], "k long"), "k", starts, "s", "name", by=16).orderBy("k").collect()
    assert [r.name for r in got] == [None, "a", "a", "b", "b", "c"]


def test_interval_map(spark):
    n = 200
    spaced = [(0, k * 10, k * 10) for k in range(n // 10)]
    rest = [(0, k, k) for k in range(n - 10) if k % 10]
    d = spark.createDataFrame(spaced + rest, "g long, start long, end long")
    assert [tuple(r)[1:] for r in intervals.interval_union(d, ["g"]).collect()] == [(0, n - 10)]
    assert intervals.overlaps(d, ["g"]).count() == 0
    rng = random.Random(5)
    rows = sorted((g, a, a + rng.randrange(9)) for g in range(3) for a in [rng.randrange(60) for _ in range(25)]) + [(7, 0, 10), (7, 5, 20), (7, 15, 18)]
    want, top = [], {}
    for g, a, b in rows:
        if a <= top.get(g, -1):
            want.append((g, a, b))
        else:
            top[g] = b
    got = intervals.overlaps(spark.createDataFrame(rows, "g long, start long, end long"), ["g"]).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_components_and_predecessors(spark):
    edges = spark.createDataFrame([(k, False, k + 1, False) for k in range(1, 40)] + [(60, False, 50, False), (70, False, 50, False)], "u long, u_rev boolean, v long, v_rev boolean")
    nodes = spark.createDataFrame([(k, "AC" if k % 2 else "GT") for k in [*range(1, 41), 50, 60, 70, 80]], "node_id long, label string")
    got = {r.node_id: r.comp for r in graph.components(edges, nodes).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 50: 50, 60: 50, 70: 50, 80: 80}
    assert {(r.node_id, r.pred) for r in graph.unique_predecessors(edges, nodes).where("node_id > 38 and not is_rev").collect()} == {(39, 38), (40, 39)}


def test_kmers_skip_other_symbols(spark):
    f = frame(spark, ["GANTTACA", "NNACGTN", "", "AC\nG"])
    assert sorted((r.seq, r.pos, r.kmer) for r in tx.kmers(f, 3).collect()) == [(0, 3, "TTA"), (0, 4, "TAC"), (0, 5, "ACA"), (1, 2, "ACG"), (1, 3, "CGT")]
    with pytest.raises(ValueError, match="at least 1"):
        tx.kmers(f, 0)
