"""Registered queries over the given tables, each with SQL that gives the same rows.

Sequences are the descriptions of `part` spelt over A, C, G, T; reads are the texts of `benchmark`. All rows and whole texts are used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import text as tx
from strandloom.operators import bwt, graph, intervals, search, stats, tags
from strandloom.plans.order import as_of, numbered, partitions
from strandloom.plans.tables import written

#: Node width of the graph, k of k-mers and of patterns, least length of matches.
WIDTH, K, P, L = 8, 9, 6, 10
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz0123456789", "ACGTACGTACGTACGTACGTACGTACACGTACGTAC"


class Inputs:
    """What queries over one folder share; built once for a session, written where it is used again."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._blocks: dict[tuple[str, int], DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def described(self) -> DataFrame:
        # a small file is one task, and spelling is work: rows are dealt out before it and written after
        p = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition(partitions(self.table("part")), "p_partkey")
        whole = F.concat("p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
        return written(p.select(F.col("p_partkey").cast("long").alias("seq"), tx.to_dna(whole).alias("t"), F.col("p_brand").alias("part")))

    @cached_property
    def seqs(self) -> DataFrame:
        return self.described.select("seq", "t")

    @cached_property
    def both(self) -> DataFrame:
        return written(self.seqs.select((2 * F.col("seq")).alias("seq"), "t").unionByName(self.seqs.select((2 * F.col("seq") + 1).alias("seq"), tx.reverse_complement(F.col("t")).alias("t"))))

    @cached_property
    def reads(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").cast("long").alias("rid"), tx.to_dna(F.col("text")).alias("t"))

    @cached_property
    def patterns(self) -> DataFrame:
        return tx.kmers(self.reads.withColumnRenamed("rid", "seq"), P).select(F.col("kmer").alias("pattern")).distinct()

    @cached_property
    def sa(self) -> DataFrame:
        return written(bwt.suffix_array(self.seqs))

    def blocks(self, k: int, both: bool = False) -> DataFrame:
        key = ("both", k) if both else ("seqs", k)
        if key not in self._blocks:
            self._blocks[key] = bwt.blocks(self.both if both else self.seqs, k)
        return self._blocks[key]

    @cached_property
    def runs(self) -> DataFrame:
        return written(bwt.bwt_runs(self.sa))

    @cached_property
    def paths(self) -> tuple[DataFrame, DataFrame]:
        nodes, steps = tags.chopped_paths(self.seqs, WIDTH)
        return written(nodes), written(steps)

    @cached_property
    def mixed(self) -> tuple[DataFrame, DataFrame]:
        """Paths over nodes of up to 5 and 9 symbols in turn; every third step is walked backward."""
        start = F.expr("(step div 2) * 14 + (step % 2) * 5")
        cut = self.seqs.where("t <> ''").select("seq", "t", F.explode(F.expr("sequence(0L, length(t) div 7)")).alias("step")).withColumn("node_start", start).where("node_start < length(t)")
        nodes, steps = tags.paths_of(cut.select("seq", "step", F.expr("step % 3 = 2").alias("is_rev"), "node_start", F.expr("substring(t, node_start + 1, if(step % 2 = 0, 5, 9))").alias("piece")))
        return written(nodes), written(steps)

    @cached_property
    def words(self) -> DataFrame:
        """Patterns of 4 to 33 symbols, those that run over a sequence's end changed in their last symbol."""
        w = F.expr("substring(concat(t, 'CA', t), 1 + seq % 5, 4 + seq % 30)")
        return self.seqs.select(w.alias("pattern"))

    @cached_property
    def tags(self) -> DataFrame:
        return written(tags.tag_array(self.sa, self.paths[1]))

    @cached_property
    def tag_runs(self) -> DataFrame:
        return written(tags.tag_runs(self.tags))

    @cached_property
    def mems(self) -> DataFrame:
        return written(search.matches(self.reads, self.seqs, self.sa, L))


_inputs: dict[tuple[str, str], Inputs] = {}


def forget() -> None:
    """Let later queries build their inputs anew."""
    _inputs.clear()


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _inputs:
        _inputs[key] = Inputs(spark, sf_dir)
    return _inputs[key]


def _dna(expr: str) -> str:
    return f"translate(regexp_replace(lower({expr}), '[^a-z0-9]', '', 'g'), '{LETTERS}', '{BASES}')"


_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


def _sa(name: str, source: str) -> str:
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY s, seq) - 1 AS row_id, seq, pos, s,
      CASE WHEN s = '' THEN '$' ELSE substring(s, 1, 1) END AS f, CASE WHEN pos = 0 THEN '$' ELSE substring(t, pos, 1) END AS c
    FROM (SELECT seq, t, pos, substring(t, pos + 1) AS s FROM {source}, LATERAL (SELECT CAST(unnest(range(0, length(t) + 1)) AS BIGINT) AS pos)))"""


#: Named parts of the SQL, in the order in which they build on each other.
PARTS = {
    "seqs": f"seqs AS (SELECT CAST(p_partkey AS BIGINT) AS seq, {_dna('concat(p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR))')} AS t, p_brand AS part FROM part)",
    "reads": f"reads AS (SELECT CAST(item_id AS BIGINT) AS rid, {_dna('text')} AS t FROM benchmark)",
    "both": f"both_ AS (SELECT 2 * seq AS seq, t FROM seqs UNION ALL SELECT 2 * seq + 1, {_RC.format('t')} FROM seqs)",
    "patterns": f"patterns AS (SELECT DISTINCT substring(t, CAST(i AS BIGINT), {P}) AS pattern FROM reads, LATERAL (SELECT unnest(range(1, length(t) - {P} + 2)) AS i))",
    "sa": _sa("sa", "seqs"),
    "sab": _sa("sab", "both_"),
    "flags": "flags AS (SELECT row_id, c, CASE WHEN c = '$' OR c IS DISTINCT FROM lag(c) OVER (ORDER BY row_id) THEN 1 ELSE 0 END AS h FROM sa)",
    "runs": "runs AS (SELECT CAST(g - 1 AS BIGINT) AS run_id, min(c) AS c, min(row_id) AS start, count(*) AS len FROM (SELECT *, sum(h) OVER (ORDER BY row_id) AS g FROM flags) GROUP BY g)",
    "carr": "carr AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c_before FROM (SELECT c, count(*) AS cnt FROM sa GROUP BY c))",
    "cut": f"cut AS (SELECT seq, step, substring(t, step * {WIDTH} + 1, {WIDTH}) AS label FROM seqs, LATERAL (SELECT CAST(unnest(range(0, (length(t) + {WIDTH - 1}) // {WIDTH})) AS BIGINT) AS step))",
    "nodes": "nodes AS (SELECT row_number() OVER (ORDER BY label) AS node_id, label FROM (SELECT DISTINCT label FROM cut))",
    "steps": f"steps AS (SELECT seq, step, node_id, false AS is_rev, step * {WIDTH} AS node_start FROM cut JOIN nodes USING (label))",
    "tags": f"tags AS (SELECT row_id, CASE WHEN f = '$' THEN 0 ELSE node_id * 2048 + pos - node_start END AS tag FROM sa LEFT JOIN steps ON steps.seq = sa.seq AND steps.step = sa.pos // {WIDTH} AND f <> '$')",
    "tagruns": "tagruns AS (SELECT CAST(g - 1 AS BIGINT) AS run_id, min(tag) AS tag, min(row_id) AS start, count(*) AS len FROM (SELECT *, sum(h) OVER (ORDER BY row_id) AS g FROM (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (ORDER BY row_id) THEN 1 ELSE 0 END AS h FROM tags)) GROUP BY g)",
    "mcut": f"mcut AS (SELECT *, CASE WHEN is_rev THEN {_RC.format('piece')} ELSE piece END AS label FROM (SELECT seq, step, step % 3 = 2 AS is_rev, node_start, substring(t, node_start + 1, CASE WHEN step % 2 = 0 THEN 5 ELSE 9 END) AS piece FROM (SELECT *, (step // 2) * 14 + (step % 2) * 5 AS node_start FROM seqs, LATERAL (SELECT CAST(unnest(range(0, length(t) // 7 + 1)) AS BIGINT) AS step)) WHERE node_start < length(t)))",
    "mnodes": "mnodes AS (SELECT row_number() OVER (ORDER BY label) AS node_id, label FROM (SELECT DISTINCT label FROM mcut))",
    "mtags": "mtags AS (SELECT row_id, CASE WHEN f = '$' THEN 0 ELSE (node_id << 11) | (CASE WHEN is_rev THEN 1024 ELSE 0 END) | (pos - node_start) END AS tag, CASE WHEN f = '$' THEN 0 ELSE (node_id << 11) | (CASE WHEN is_rev THEN 0 ELSE 1024 END) | (length(mcut.label) - 1 - (pos - node_start)) END AS back FROM sa LEFT JOIN (mcut JOIN mnodes USING (label)) ON mcut.seq = sa.seq AND sa.pos >= node_start AND sa.pos < node_start + length(mcut.label))",
    "words": "words AS (SELECT DISTINCT substring(concat(t, 'CA', t), 1 + seq % 5, 4 + seq % 30) AS pattern FROM seqs)",
    "uk": f"uk AS (SELECT kmer, min(tag) AS tag FROM (SELECT substring(s, 1, {K}) AS kmer, tag FROM sa JOIN tags USING (row_id) WHERE length(s) >= {K}) GROUP BY kmer HAVING count(DISTINCT tag) = 1)",
    "covered": f"covered AS (SELECT row_id, seq, pos, tags.tag FROM sa JOIN tags USING (row_id) JOIN uk ON uk.kmer = substring(s, 1, {K}))",
    "edges": "edges AS (SELECT DISTINCT a.node_id AS u, b.node_id AS v FROM steps a JOIN steps b ON a.seq = b.seq AND b.step = a.step + 1)",
    "preds": "preds AS (SELECT v AS node_id, right(label, 1) AS base, min(u) AS pred FROM edges JOIN nodes ON nodes.node_id = u GROUP BY 1, 2 HAVING count(*) = 1)",
    "hit": f"""hit AS (SELECT rid, a, seq, pos, a - pos AS dg FROM (SELECT rid, CAST(i AS BIGINT) AS a, substring(t, CAST(i AS BIGINT) + 1, {L}) AS k FROM reads, LATERAL (SELECT unnest(range(0, length(t) - {L} + 1)) AS i)) r
      JOIN (SELECT seq, pos, substring(s, 1, {L}) AS k FROM sa WHERE length(s) >= {L}) q USING (k))""",
    "isl": f"isl AS (SELECT rid, seq, dg, min(a) AS a0, max(a) + {L} AS b0 FROM (SELECT *, a - row_number() OVER (PARTITION BY rid, seq, dg ORDER BY a) AS g FROM hit) GROUP BY rid, seq, dg, g)",
}


def _mem_sql(m: int) -> str:
    return f"""ms AS (SELECT rid, a, b FROM (SELECT rid, CAST(a AS BIGINT) AS a, b0 AS b, row_number() OVER (PARTITION BY rid, a ORDER BY b0 DESC) AS rn FROM isl, LATERAL (SELECT unnest(range(a0, b0 - {L} + 1)) AS a)) WHERE rn = {m}),
    mem AS (SELECT rid, a, b FROM (SELECT *, lag(b) OVER (PARTITION BY rid ORDER BY a) AS pb, lag(a) OVER (PARTITION BY rid ORDER BY a) AS pa FROM ms) WHERE pa IS NULL OR pa < a - 1 OR pb < b),
    mems AS (SELECT rid, mem.a, mem.b, min(row_id) AS bwt_start, count(*) AS size FROM mem JOIN isl USING (rid) JOIN sa ON sa.seq = isl.seq AND sa.pos = mem.a - isl.dg WHERE a0 <= mem.a AND b0 >= mem.b GROUP BY 1, 2, 3)"""


def _sql(parts: str, body: str, more: str = "", recursive: bool = False) -> str:
    named = [PARTS[p] for p in parts.split()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*named, *([more] if more else [])]) + f"\n{body}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(fn):
        name = fn.__name__.strip("_")
        QUERIES[name] = lambda spark, sf_dir: fn(inputs(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return keep


_SA, _RUNS, _TAGS = "seqs sa", "seqs sa flags runs", "seqs sa cut nodes steps tags"

# Sources and text


@_query(_sql("seqs", "SELECT seq, t FROM seqs"))
def seqs_scan(x):
    return x.seqs


@_query(_sql("reads", "SELECT rid, t FROM reads WHERE length(t) > 0"))
def reads_nonempty(x):
    return x.reads.where(F.length("t") > 0)


@_query(_sql("seqs", f"SELECT seq, {_RC.format('t')} AS rc FROM seqs"))
def revcomp(x):
    return x.seqs.select("seq", tx.reverse_complement(F.col("t")).alias("rc"))


@_query(_sql(_SA, f"SELECT seq, pos, substring(s, 1, {K}) AS kmer FROM sa WHERE length(s) >= {K}"))
def kmers_forward(x):
    return tx.kmers(x.seqs, K)


@_query(_sql(_SA, f"SELECT seq, pos, false AS is_rev, substring(s, 1, {K}) AS kmer FROM sa WHERE length(s) >= {K} UNION ALL SELECT seq, pos + {K - 1}, true, {_RC.format(f'substring(s, 1, {K})')} FROM sa WHERE length(s) >= {K}"))
def kmers_both(x):
    return tx.kmers_both(x.seqs, K)


@_query(f"SELECT seq, pos, kmer FROM (SELECT CAST(item_id AS BIGINT) AS seq, CAST(i AS BIGINT) AS pos, substring(t, CAST(i AS BIGINT) + 1, 4) AS kmer FROM (SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS t FROM benchmark), LATERAL (SELECT unnest(range(0, length(t) - 3)) AS i)) WHERE regexp_full_match(kmer, '[ACGT]+')")
def kmer_valid_filter(x):
    t = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return tx.kmers(x.table("benchmark").select(F.col("item_id").cast("long").alias("seq"), t.alias("t")), 4)


# Transform


@_query(_sql(_SA, "SELECT row_id, seq, pos FROM sa"))
def suffix_array(x):
    return x.sa.select("row_id", "seq", "pos")


@_query(_sql(_SA, "SELECT row_id, seq FROM sa"))
def document_array(x):
    return x.sa.select("row_id", "seq")


@_query(_sql(_SA, "SELECT row_id, c FROM sa"))
def bwt_chars(x):
    return x.sa.select("row_id", "c")


@_query(_sql(_RUNS, "SELECT run_id, c, start, len FROM runs"))
def bwt_runs(x):
    return x.runs


@_query(_sql(_RUNS, "SELECT count(*) AS runs, CAST(sum(CASE WHEN c = '$' THEN 1 ELSE 0 END) AS BIGINT) AS end_runs FROM runs"))
def run_count(x):
    return x.runs.agg(F.count("*").alias("runs"), F.sum((F.col("c") == "$").cast("long")).alias("end_runs"))


@_query(_sql(_SA + " carr", "SELECT c, code, cnt, c_before FROM carr"))
def c_array(x):
    return bwt.c_array(x.sa)


@_query(_sql(_SA, "SELECT row_id, f FROM sa"))
def f_column(x):
    starts = bwt.c_array(x.sa).select(F.col("c_before").alias("start"), "c")
    return as_of(x.sa.select("row_id"), "row_id", starts, "start", "c").select("row_id", F.col("c").alias("f"))


@_query(_sql(_SA + " carr", "SELECT row_id, c, c_before + row_number() OVER (PARTITION BY sa.c ORDER BY row_id) - 1 AS lf FROM sa JOIN carr USING (c)"))
def lf_mapping(x):
    return bwt.lf_mapping(x.sa)


@_query(_sql(_SA, "SELECT row_id, count(*) FILTER (c = 'A') OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rank_a FROM sa"))
def rank_prefix(x):
    return bwt.ranks(x.sa).select("row_id", F.col("r_A").alias("rank_a"))


@_query(_sql(_SA, "SELECT row_id, " + ", ".join(f"CAST(count(*) FILTER (c = '{s}') OVER w AS BIGINT) AS {n}" for n, s in (("ends", "$"), ("a", "A"), ("c", "C"), ("g", "G"), ("t", "T"))) + " FROM sa WINDOW w AS (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def rank_all_symbols(x):
    return bwt.ranks(x.sa).select("row_id", F.col("r_$").alias("ends"), F.col("r_A").alias("a"), F.col("r_C").alias("c"), F.col("r_G").alias("g"), F.col("r_T").alias("t"))


@_query(_sql(_RUNS, "SELECT * FROM (SELECT run_id // 10 AS block, start, " + ", ".join(f"CAST(coalesce(sum(len) FILTER (c = '{s}') OVER w, 0) AS BIGINT) AS {n}" for n, s in (("ends", "$"), ("a", "A"), ("c_", "C"), ("g", "G"), ("t", "T"))) + ", run_id % 10 AS z FROM runs WINDOW w AS (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE z = 0"))
def block_cum_ranks(x):
    b = bwt.block_ranks(x.runs)
    return b.select("block", "start", "ends", F.col("A").alias("a"), F.col("C").alias("c_"), F.col("G").alias("g"), F.col("T").alias("t"), F.lit(0).cast("long").alias("z"))


@_query(_sql(_RUNS, "SELECT run_id, seq, pos FROM runs JOIN sa ON row_id = start"))
def sa_head_samples(x):
    return bwt.samples(x.sa, x.runs, False)


@_query(_sql(_RUNS, "SELECT run_id, seq, pos FROM runs JOIN sa ON row_id = start + len - 1"))
def sa_tail_samples(x):
    return bwt.samples(x.sa, x.runs, True)


@_query(_sql(_SA, "SELECT * FROM (SELECT seq, pos, lead(seq) OVER (ORDER BY row_id) AS next_seq, lead(pos) OVER (ORDER BY row_id) AS next_pos FROM sa) WHERE next_seq IS NOT NULL"))
def locate_next(x):
    return bwt.locate_next(x.sa)


@_query(_sql(_SA, "SELECT row_id, seq, pos FROM sa WHERE f = '$'"))
def endmarker_occ(x):
    return x.sa.where("f = '$'").select("row_id", "seq", "pos")


@_query(_sql(_RUNS, "SELECT row_id, run_id, row_id - start AS run_offset FROM sa JOIN runs ON row_id >= start AND row_id < start + len"))
def row_to_run(x):
    return bwt.run_of_row(x.sa, x.runs)


@_query(_sql(_RUNS, "SELECT run_id, len FROM runs WHERE run_id = (SELECT max(run_id) FROM runs)"))
def last_run(x):
    return x.runs.agg(F.max("run_id").alias("run_id"), F.max_by("len", "run_id").alias("len"))


@_query(_sql(_SA, "SELECT row_id, seq * 128 + pos AS packed, seq, pos FROM sa"))
def pack_unpack(x):
    d = x.sa.select("row_id", tx.pack(F.col("seq"), F.col("pos"), 128).alias("packed"))
    seq, pos = tx.unpack("packed", 128)
    return d.select("row_id", "packed", seq.cast("long").alias("seq"), pos.cast("long").alias("pos"))


# Search

_COUNT = f"SELECT pattern, min(row_id) AS lo, max(row_id) AS hi FROM patterns JOIN sa ON substring(s, 1, {P}) = pattern GROUP BY 1"


@_query(_sql("seqs reads patterns sa", _COUNT))
def count_patterns(x):
    return search.count_fixed(x.patterns, x.blocks(P))


@_query(_sql("seqs reads patterns", "SELECT pattern FROM patterns WHERE NOT EXISTS (SELECT 1 FROM seqs WHERE contains(t, pattern))"))
def count_no_match(x):
    return x.patterns.hint("merge").join(x.blocks(P).select(F.col("kmer").alias("pattern")), "pattern", "left_anti")


@_query(_sql("seqs reads patterns", "SELECT pattern, seq FROM patterns JOIN seqs ON contains(t, pattern)"))
def locate_seqs(x):
    return search.locate(x.patterns, x.seqs)


@_query(_sql("seqs reads patterns sa", f"SELECT substring(s, 1, {P + 1}) AS pattern, min(row_id) AS lo, max(row_id) AS hi FROM patterns JOIN sa ON substring(s, 1, {P + 1}) = 'A' || pattern GROUP BY 1"))
def lf_step_range(x):
    return search.lf_step(search.count_fixed(x.patterns, x.blocks(P)), "A", bwt.ranks(x.sa), bwt.c_array(x.sa))


def _bi_sql(where: str) -> str:
    n = P + 1
    return _sql("seqs both reads patterns sab", f"SELECT a.k AS pattern, a.lo AS k, b.lo AS l, a.n AS s FROM g a JOIN g b ON b.k = {_RC.format('a.k')} JOIN patterns ON {where}", f"g AS (SELECT substring(s, 1, {n}) AS k, min(row_id) AS lo, count(*) AS n FROM sab WHERE length(s) >= {n} GROUP BY 1)")


@_query(_bi_sql(f"pattern = substring(a.k, 2, {P})"))
def fmd_backward(x):
    held = x.blocks(P, True)
    return search.backward_extend(search.bi_intervals(x.patterns, held), "ACGT", bwt.bounds(held, x.both), bwt.c_array(bwt.suffixes(x.both, 1)))


@_query(_bi_sql(f"pattern = substring(a.k, 1, {P})"))
def fmd_forward(x):
    held = x.blocks(P, True)
    return search.forward_extend(search.bi_intervals(x.patterns, held), "ACGT", bwt.bounds(held, x.both), bwt.c_array(bwt.suffixes(x.both, 1)))


@_query(_sql("seqs both reads patterns sab", f"SELECT pattern, a.lo AS k, b.lo AS l, a.n AS s, a.n = b.n AS even FROM patterns JOIN g a ON a.k = pattern JOIN g b ON b.k = {_RC.format('pattern')}", f"g AS (SELECT substring(s, 1, {P}) AS k, min(row_id) AS lo, count(*) AS n FROM sab WHERE length(s) >= {P} GROUP BY 1)"))
def fmd_symmetry(x):
    rc = x.patterns.select(tx.reverse_complement(F.col("pattern")).alias("pattern"))
    at = search.bi_intervals(x.patterns.unionByName(rc).distinct(), x.blocks(P, True))
    turned = at.select(tx.reverse_complement(F.col("pattern")).alias("pattern"), F.col("s").alias("s2"))
    return at.join(x.patterns, "pattern").join(turned, "pattern").select("pattern", "k", "l", "s", (F.col("s") == F.col("s2")).alias("even"))


@_query(_sql("seqs reads", "SELECT rid, coalesce((SELECT max(n) FROM (SELECT unnest(range(1, length(r.t) + 1)) AS n) WHERE EXISTS (SELECT 1 FROM seqs WHERE contains(seqs.t, right(r.t, n)))), 0) AS len FROM reads r"))
def suffix_match_len(x):
    return search.longest_suffix(x.reads, x.seqs)


@_query(_sql("seqs reads sa hit isl", "SELECT rid, a, b, bwt_start, size FROM mems", _mem_sql(1)))
def mems_min_occ1(x):
    return x.mems


@_query(_sql("seqs reads sa hit isl", "SELECT rid, a, b, bwt_start, size FROM mems", _mem_sql(3)))
def mems_min_occ_m(x):
    return search.matches(x.reads, x.seqs, x.sa, L, 3)


_MEM_TAGS = "seqs reads sa cut nodes steps tags tagruns hit isl"


@_query(_sql(_MEM_TAGS, "SELECT rid, a, b, bwt_start, size, count(DISTINCT tag) AS positions, string_agg(DISTINCT CAST(tag AS VARCHAR), ',' ORDER BY CAST(tag AS VARCHAR)) AS tags FROM mems JOIN tags ON row_id BETWEEN bwt_start AND bwt_start + size - 1 GROUP BY 1, 2, 3, 4, 5", _mem_sql(1)))
def mem_tags(x):
    q = x.mems.select("rid", "a", "b", "bwt_start", "size", F.col("bwt_start").alias("lo"), (F.col("bwt_start") + F.col("size") - 1).alias("hi"))
    hits = tags.overlapping(q, x.tag_runs)
    return hits.groupBy("rid", "a", "b", "bwt_start", "size").agg(F.countDistinct("tag").alias("positions"), F.array_join(F.array_sort(F.collect_set(F.col("tag").cast("string"))), ",").alias("tags"))


# Tags


@_query(_sql("seqs cut nodes steps", "SELECT seq, step, node_id, is_rev, node_start FROM steps"))
def path_steps(x):
    return x.paths[1].drop("size")


@_query(_sql(_TAGS, "SELECT row_id, tag FROM tags"))
def tag_array(x):
    return x.tags


@_query(_sql(_TAGS + " tagruns", "SELECT run_id, tag, start, len FROM tagruns"))
def tag_runs_logical(x):
    return x.tag_runs


_PIECES = "SELECT start + 511 * p AS start, least(511, len - 511 * p) AS len, tag FROM tagruns, LATERAL (SELECT CAST(unnest(range(0, (len + 510) // 511)) AS BIGINT) AS p) WHERE tag <> 0"


@_query(_sql(_TAGS + " tagruns", _PIECES))
def tag_runs_physical(x):
    return tags.physical(x.tag_runs)


@_query(_sql("seqs cut nodes steps", f"SELECT seq, step, (node_id << 11) | (step % 2 << 10) | (step * 37 % 1024) AS tag, (node_id << 20) | ((step % 511 + 1) << 11) | (step % 2 << 10) | (step * 37 % 1024) AS run_tag FROM steps"))
def tag_encode(x):
    s = x.paths[1]
    node, rev, off = F.col("node_id"), F.col("step") % 2, F.col("step") * 37 % 1024
    return s.select("seq", "step", tx.encode_tag(node, rev, off).alias("tag"), tx.encode_tag_run(node, rev, off, F.col("step") % 511 + 1).alias("run_tag"))


@_query(_sql(_TAGS + " tagruns", "SELECT run_id, tag >> 11 AS node_id, (tag >> 10) & 1 AS is_rev, tag & 1023 AS off FROM tagruns"))
def tag_decode(x):
    node, rev, off = tx.decode_tag(F.col("tag"))
    return x.tag_runs.select("run_id", node.alias("node_id"), rev.alias("is_rev"), off.alias("off"))


@_query(_sql(_TAGS + " tagruns", "SELECT run_id, start FROM tagruns WHERE run_id % 10 = 0"))
def tag_sample_every_10(x):
    return x.tag_runs.where("run_id % 10 = 0").select("run_id", "start")


@_query(_sql("seqs reads patterns sa cut nodes steps tags tagruns", "SELECT pattern, tag FROM q JOIN tags ON row_id BETWEEN lo AND hi GROUP BY 1, 2", f"q AS ({_COUNT})"))
def tag_overlap_query(x):
    return tags.overlapping(search.count_fixed(x.patterns, x.blocks(P)), x.tag_runs).select("pattern", "tag").distinct()


@_query(_sql("seqs reads patterns sa cut nodes steps tags tagruns", "SELECT pattern AS qid, count(DISTINCT tag) AS tags_distinct, count(*) AS runs_logical, CAST(sum((len + 510) // 511) AS BIGINT) AS runs_physical FROM q JOIN tagruns ON start <= hi AND start + len - 1 >= lo GROUP BY 1", f"q AS ({_COUNT})"))
def query_tags(x):
    return tags.query_tags(search.count_fixed(x.patterns, x.blocks(P)).withColumnRenamed("pattern", "qid"), x.tag_runs)


@_query(_sql(_TAGS + " tagruns", f"SELECT start, len, tag FROM ({_PIECES}) UNION ALL SELECT 0, count(*), 0 FROM seqs"))
def convert_tags(x):
    parts = written(numbered(tags.physical(x.tag_runs), ["start"], "ordinal").select("ordinal", "len", "tag"))
    return tags.convert(parts, x.seqs.count())


@_query(_sql(_TAGS, "SELECT row_id, tag FROM tags"))
def merge_tags(x):
    # each part is sorted by itself: nothing here comes from the order of the whole
    own = bwt.suffix_array(x.described, ("part",)).select(F.col("row_id").alias("at"), "part", "seq", "pos", "f")
    own = written(tags.ordinals(own, "part", "at"))
    tagged = tags.tag_array(own.select(F.col("at").alias("row_id"), "seq", "pos", "f"), x.paths[1])
    part_tags = own.select(F.col("at").alias("row_id"), "part", "ordinal").join(tagged.hint("merge"), "row_id").select("part", "ordinal", "tag")
    return tags.merge(x.sa, x.described.select("seq", "part"), part_tags)


@_query(_sql("seqs sa mcut mnodes mtags", "SELECT row_id, tag FROM mtags"))
def tag_array_mixed(x):
    return tags.tag_array(x.sa, x.mixed[1])


@_query(_sql("seqs words sa", "SELECT pattern, min(row_id) AS lo, max(row_id) AS hi FROM words JOIN sa ON starts_with(s, pattern) GROUP BY 1"))
def count_words(x):
    return search.count(x.words, x.seqs, x.sa)


@_query(_sql("seqs words", "SELECT pattern, seq FROM words JOIN seqs ON contains(t, pattern)"))
def locate_words(x):
    return search.locate(x.words, x.seqs)


# Graph


@_query(_sql("seqs sa mcut mnodes mtags", "SELECT kmer, min(tag) AS tag FROM k GROUP BY 1 HAVING count(DISTINCT tag) = 1", f"""k AS (SELECT substring(s, 1, {K}) AS kmer, tag FROM sa JOIN mtags USING (row_id) WHERE length(s) >= {K} UNION ALL
  SELECT {_RC.format(f'substring(a.s, 1, {K})')}, back FROM sa a JOIN sa b ON a.seq = b.seq AND b.pos = a.pos + {K - 1} JOIN mtags ON mtags.row_id = b.row_id WHERE length(a.s) >= {K})"""))
def unique_kmers_mixed(x):
    return graph.unique_kmers(x.seqs, x.mixed[1], K, True)


@_query(_sql("seqs sa mcut mnodes mtags", "SELECT row_id, tag, tag AS path_tag FROM mtags WHERE false"))
def disagreeing_tags(x):
    reached = graph.extend(x.sa, graph.covered_rows(x.seqs, x.sa, x.mixed[1], K), x.mixed[1], x.mixed[0])
    return tags.disagreeing(reached, tags.tag_array(x.sa, x.mixed[1]))


@_query(_sql(_TAGS + " uk", "SELECT kmer, tag FROM uk"))
def unique_kmers(x):
    return graph.unique_kmers(x.seqs, x.paths[1], K)


@_query(_sql(_TAGS, "SELECT kmer, min(tag) AS tag FROM k GROUP BY 1 HAVING count(DISTINCT tag) = 1", f"""k AS (SELECT substring(s, 1, {K}) AS kmer, tag FROM sa JOIN tags USING (row_id) WHERE length(s) >= {K} UNION ALL
  SELECT {_RC.format(f'substring(a.s, 1, {K})')}, nodes.node_id * 2048 + 1024 + length(label) - 1 - (tag & 1023) FROM sa a JOIN sa b ON a.seq = b.seq AND b.pos = a.pos + {K - 1} JOIN tags ON tags.row_id = b.row_id JOIN nodes ON nodes.node_id = tag >> 11 WHERE length(a.s) >= {K})"""))
def unique_kmers_both(x):
    return graph.unique_kmers(x.seqs, x.paths[1], K, True)


@_query(_sql(_SA, f"SELECT substring(s, 1, {K}) AS kmer, min(row_id) AS lo, count(*) AS size FROM sa WHERE length(s) >= {K} GROUP BY 1"))
def kmer_intervals(x):
    return graph.kmer_intervals(x.seqs, K)


@_query(_sql(_TAGS + " uk", f"SELECT uk.kmer, min(row_id) AS lo, count(*) AS size, min(tag) AS tag FROM sa JOIN uk ON uk.kmer = substring(s, 1, {K}) GROUP BY 1"))
def kmer_tag_join(x):
    return graph.kmer_intervals(x.seqs, K).hint("merge").join(graph.unique_kmers(x.seqs, x.paths[1], K), "kmer").select("kmer", "lo", "size", "tag")


def _share(rows: DataFrame, sa: DataFrame) -> DataFrame:
    n = sa.agg(F.count("*").alias("rows"))
    return rows.agg(F.count("*").alias("covered")).withColumn("z", F.lit(1)).join(n.withColumn("z", F.lit(1)), "z").select("covered", "rows", F.round(F.col("covered") / F.col("rows"), 6).alias("share"))


@_query(_sql(_TAGS + " uk covered", "SELECT c AS covered, n AS rows, round(c / n, 6) AS share FROM (SELECT (SELECT count(*) FROM covered) AS c, (SELECT count(*) FROM sa) AS n)"))
def coverage_kmers(x):
    return _share(graph.covered_rows(x.seqs, x.sa, x.paths[1], K), x.sa)


_EXT = f"ext AS (SELECT seq, pos FROM covered UNION SELECT e.seq, e.pos - 1 FROM ext e JOIN steps ON steps.seq = e.seq AND steps.step = e.pos // {WIDTH} JOIN seqs ON seqs.seq = e.seq LEFT JOIN preds ON preds.node_id = steps.node_id AND base = substring(t, e.pos, 1) WHERE e.pos > 0 AND (e.pos % {WIDTH} > 0 OR pred IS NOT NULL))"
_EXT_PARTS = _TAGS + " uk covered edges preds"


@_query(_sql(_EXT_PARTS, "SELECT row_id, tag FROM ext JOIN sa USING (seq, pos) JOIN tags USING (row_id)", _EXT, True))
def extension_fixpoint(x):
    return graph.extend(x.sa, graph.covered_rows(x.seqs, x.sa, x.paths[1], K), x.paths[1], x.paths[0]).select("row_id", "tag")


@_query(_sql(_EXT_PARTS, "SELECT c AS covered, n AS rows, round(c / n, 6) AS share FROM (SELECT (SELECT count(*) FROM ext) AS c, (SELECT count(*) FROM sa) AS n)", _EXT, True))
def coverage_extended(x):
    return _share(graph.extend(x.sa, graph.covered_rows(x.seqs, x.sa, x.paths[1], K), x.paths[1], x.paths[0]), x.sa)


@_query(_sql("seqs cut nodes steps edges preds", "SELECT node_id, base, pred FROM preds"))
def unique_predecessors(x):
    return graph.unique_predecessors(graph.edges(x.paths[1]), x.paths[0]).where("not is_rev").select("node_id", "base", "pred")


_COMP = "reach AS (SELECT node_id AS a, node_id AS b FROM nodes UNION SELECT a, w FROM reach JOIN (SELECT u, v AS w FROM edges UNION SELECT v, u FROM edges) ON u = b), comp AS (SELECT a AS node_id, min(b) AS comp FROM reach GROUP BY 1)"


@_query(None)
def node_component(x):
    return graph.components(graph.edges(x.paths[1]), x.paths[0])


@_query(None)
def seq_component(x):
    comp = graph.components(graph.edges(x.paths[1]), x.paths[0])
    return x.paths[1].where("step = 0").join(comp, "node_id").select("seq", "comp")


@_query(None)
def component_sizes(x):
    return graph.components(graph.edges(x.paths[1]), x.paths[0]).groupBy("comp").agg(F.count("*").alias("nodes"))


# Intervals and statistics

_SPANS = "spans AS (SELECT CAST(o_custkey AS BIGINT) AS cust, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS start, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 30 AS \"end\" FROM orders)"


def _spans(x):
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
    return x.table("orders").select(F.col("o_custkey").cast("long").alias("cust"), day.alias("start"), (day + 30).alias("end"))


@_query(f"""WITH {_SPANS} SELECT cust, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY cust ORDER BY start, "end") AS g FROM (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY cust ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM spans)) GROUP BY cust, g""")
def interval_union(x):
    return intervals.interval_union(_spans(x), ["cust"])


@_query(_sql(_TAGS + " tagruns", "SELECT row_id, tag FROM tags"))
def interval_floor_lookup(x):
    return intervals.floor_lookup(x.sa.select("row_id"), "row_id", x.tag_runs.where("tag <> 0"))


@_query(_sql(_TAGS, "SELECT row_id, tag FROM tags"))
def gap_fill(x):
    covered = graph.covered_rows(x.seqs, x.sa, x.paths[1], K)
    return intervals.gap_fill(covered, x.tags)


@_query(_sql(_RUNS + " cut nodes steps tags tagruns", """SELECT 'rows' AS component, (SELECT count(*) FROM sa) AS items UNION ALL SELECT 'sequences', count(*) FROM seqs UNION ALL SELECT 'max_length', max(length(t)) + 1 FROM seqs
  UNION ALL SELECT 'runs', count(*) FROM runs UNION ALL SELECT 'tag_runs', count(*) FROM tagruns WHERE tag <> 0 UNION ALL SELECT 'tag_pieces', CAST(sum((len + 510) // 511) AS BIGINT) FROM tagruns WHERE tag <> 0"""))
def index_stats(x):
    return stats.index_stats(x.seqs, x.runs, x.tag_runs)


@_query(_sql(_TAGS, "SELECT part, CAST(sum(h) AS BIGINT) AS runs FROM (SELECT part, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY part ORDER BY row_id) THEN 1 ELSE 0 END AS h FROM tags JOIN sa USING (row_id) JOIN seqs USING (seq)) GROUP BY 1"))
def tag_runs_per_partition(x):
    w = Window.partitionBy("part").orderBy("row_id")
    d = x.tags.join(x.sa.select("row_id", "seq"), "row_id").join(x.described.select("seq", "part"), "seq")
    heads = d.withColumn("before", F.lag("tag").over(w)).where("before is null or before <> tag")
    return stats.runs_per_part(heads)


@_query(_sql(_MEM_TAGS, "SELECT rid, count(DISTINCT tag) AS positions FROM mems JOIN tags ON row_id BETWEEN bwt_start AND bwt_start + size - 1 GROUP BY 1", _mem_sql(1)))
def distinct_tags_per_read(x):
    q = x.mems.select("rid", F.col("bwt_start").alias("lo"), (F.col("bwt_start") + F.col("size") - 1).alias("hi"))
    return tags.overlapping(q, x.tag_runs).groupBy("rid").agg(F.countDistinct("tag").alias("positions"))


for _name, _body in (("node_component", "SELECT node_id, comp FROM comp"), ("seq_component", "SELECT seq, comp FROM steps JOIN comp USING (node_id) WHERE step = 0"), ("component_sizes", "SELECT comp, count(*) AS nodes FROM comp GROUP BY 1")):
    SQL[_name] = _sql("seqs cut nodes steps edges", _body, _COMP, True)
