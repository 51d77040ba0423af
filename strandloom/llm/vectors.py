"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of BLOCK dimensions. A cosine of at least t means a squared distance of at
most 2 - 2t; were every block's squared distance over its share (in proportion to its dimensions), the sum would be over the whole.
So every pair is found in some block as a pair within that block's radius, and is then confirmed on the whole vectors.

Vectors are packed into chunks, and chunks whose boxes are near enough meet in a product of partitions: nothing is copied to
disk for the comparison, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table
from strandloom.plans.components import connected_components
from strandloom.plans.order import partitions
from strandloom.plans.tables import drop, written as save

COSINE, BLOCK = 0.9, 32
#: Vectors of a chunk, rows of a tile, and chunks that a task holds at most to compare others with.
CHUNK, TILE, HELD = 2048, 256, 64
#: Rotated coordinates whose signs order the vectors.
SIGNS = 32
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=16)
def blocks(d: int, cosine: float) -> tuple[tuple[int, int, float], ...]:
    """(first, end, squared-distance budget) of each block."""
    m = max(1, round(d / BLOCK))
    ends = [d * k // m for k in range(m + 1)]
    return tuple((a, b, (2 - 2 * cosine) * (b - a) / d) for a, b in zip(ends, ends[1:]))


def units(x: np.ndarray) -> np.ndarray:
    big = x / np.abs(x).max(axis=1, keepdims=True)
    return (big / np.sqrt((big * big).sum(axis=1, keepdims=True))) @ rotation(x.shape[1])


def _nodes(kind: type):
    """vec_id, 128 bits that stand for the vector, and its values; both null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(nodes, batches)

    def nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
        vecs, names = [], []
        for v in batch.column(1):
            x = None if v.as_py() is None else v.values
            raw = None
            if x is not None and len(x) and not x.null_count:
                x = x.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
            vecs.append(raw)
            names.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "node", "raw"])

    return run


def _cells(kind: type):
    """d, cell (the signs of a vector's first rotated coordinates, so that alike vectors mostly lie near each other), node, copies and raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(2).to_pylist()
            dims = np.array([len(r) // np.dtype(kind).itemsize for r in raws], np.int64)
            cells = np.zeros(len(raws), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                signs = units(np.frombuffer(b"".join(raws[k] for k in at.tolist()), kind).reshape(len(at), d).astype(np.float64))[:, :SIGNS] > 0
                cells[at] = signs @ (1 << np.arange(signs.shape[1])[::-1])
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(cells), *batch.columns], names=["d", "cell", "node", "copies", "raw"])

    return run


def _pack(kind: type):
    """Chunks of at most CHUNK vectors of one length that follow each other: their nodes, copies and values, and the box of their rotated coordinates."""
    schema = pa.schema([("d", pa.int64()), ("nodes", pa.binary()), ("copies", pa.binary()), ("raws", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

    def chunk(d: int, rows: list[tuple]) -> pa.RecordBatch:
        names, copies, raws = zip(*rows)
        raw = b"".join(raws)
        u = units(np.frombuffer(raw, kind).reshape(len(rows), d).astype(np.float64))
        return pa.RecordBatch.from_pylist([{"d": d, "nodes": b"".join(names), "copies": np.array(copies, np.int64).tobytes(), "raws": raw, "lo": u.min(axis=0).tolist(), "hi": u.max(axis=0).tolist()}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, length = [], None
        for batch in batches:
            for d, *row in zip(*(batch.column(c).to_pylist() for c in ("d", "node", "copies", "raw"))):
                if held and (d != length or len(held) == CHUNK):
                    yield chunk(length, held)
                    held = []
                held.append(row)
                length = d
        if held:
            yield chunk(length, held)

    return run


class Forest:
    """Labels of a task's vectors; joined labels become the smaller."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            lo, hi = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            to = np.arange(len(self.label))
            np.minimum.at(to, hi, lo)
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


class Chunk:
    """The vectors of a chunk; what only the confirmation of candidates takes is made when it is asked for."""

    def __init__(self, d: int, copies: bytes, raws: bytes, kind: type):
        self.copies = np.frombuffer(copies, np.int64)
        self.raw = np.frombuffer(raws, kind).reshape(len(self.copies), d)

    def __len__(self) -> int:
        return len(self.copies)

    @cached_property
    def x(self) -> np.ndarray:
        x = self.raw.astype(np.float64)
        return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, and squares stay finite

    @cached_property
    def norm(self) -> np.ndarray:
        return np.sqrt((self.x * self.x).sum(axis=1))

    @cached_property
    def u(self) -> np.ndarray:
        return units(self.x)

    def sides(self, parts: tuple[tuple[int, int, float], ...], right: bool) -> list[np.ndarray]:
        """For each block, the side of a product that gives minus half of all squared distances in it."""
        out = []
        for first, end, _ in parts:
            own = self.u[:, first:end]
            half, ones = ((own**2).sum(axis=1) / 2)[:, None], np.ones((len(own), 1))
            out.append(np.hstack((own, ones, -half) if right else (own, -half, ones)).astype(np.float32))
        return out


def _compare(cosine: float, kind: type):
    """The links of each node of a task's pairs of chunks, and a spanning forest of them."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("w", pa.int64())])

    def compare(one: Chunk, left: list[np.ndarray], two: Chunk, right: list[np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of one, rows of two) that are linked; each pair comes once, from the first block that finds it."""
        parts = blocks(one.raw.shape[1], cosine)
        for b, (_, _, budget) in enumerate(parts):
            least = np.float32(-(budget * (1 + 1e-4) + 1e-5) / 2)
            for at in range(0, len(one), TILE):
                lo = at if same else 0
                near = np.flatnonzero(left[b][at : at + TILE] @ right[b][lo:].T >= least)
                for a in range(0, len(near), 50_000):
                    q, t = np.divmod(near[a : a + 50_000], len(two) - lo)
                    q, t = q + at, t + lo
                    if same:
                        q, t = q[q < t], t[q < t]
                    ok = (one.x[q] * two.x[t]).sum(axis=1) / (one.norm[q] * two.norm[t]) >= cosine
                    q, t = q[ok], t[ok]
                    if len(q):
                        gap = (one.u[q] - two.u[t]) ** 2
                        within = np.stack([gap[:, f:e].sum(axis=1) <= most * (1 + 1e-9) + 1e-12 for f, e, most in parts], axis=1)
                        ok = within.argmax(axis=1) == b  # a pair that more blocks find counts in the first
                        if ok.any():
                            yield q[ok], t[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        names, links, forest, rights = [], np.zeros(0, np.int64), Forest(0), {}
        one, held, left = None, None, []

        def place(chunk: int, nodes: bytes) -> int:
            nonlocal links
            if chunk not in at:
                at[chunk] = len(links)
                names.append(nodes)
                links = np.concatenate([links, np.zeros(len(nodes) // 16, np.int64)])
                forest.label = np.concatenate([forest.label, np.arange(len(forest.label), len(links))])
            return at[chunk]

        for batch in batches:
            for k in range(len(batch)):
                i, j, d, *cols = (c[k].as_py() for c in batch.columns)
                first, second = place(i, cols[0]), place(j, cols[3])
                if held != i:
                    held, one = i, Chunk(d, cols[1], cols[2], kind)
                    left = one.sides(blocks(d, cosine), False)
                two = one if i == j else Chunk(d, cols[4], cols[5], kind)
                if j not in rights:
                    rights[j] = two.sides(blocks(d, cosine), True)
                pair = Forest(len(one) + (0 if i == j else len(two)))
                shift = 0 if i == j else len(one)
                for q, t in compare(one, left, two, rights[j], i == j):
                    np.add.at(links, first + q, two.copies[t])
                    np.add.at(links, second + t, one.copies[q])
                    pair.join(q, t + shift)
                joined = np.flatnonzero(pair.label != np.arange(len(pair.label)))
                if len(joined):
                    whole = np.concatenate([first + np.arange(len(one)), second + np.arange(len(two))])
                    forest.join(whole[pair.label[joined]], whole[joined])
        nodes = b"".join(names)
        name = lambda rows: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.frombuffer(nodes, "V16")[rows].tobytes())]).cast(pa.binary())
        some, joined = np.flatnonzero(links), np.flatnonzero(forest.label != np.arange(len(links)))
        if len(some):
            yield pa.RecordBatch.from_arrays([name(some), pa.nulls(len(some), pa.binary()), pa.array(links[some])], schema=schema)
        if len(joined):
            yield pa.RecordBatch.from_arrays([name(joined), name(forest.label[joined]), pa.array(np.zeros(len(joined), np.int64))], schema=schema)

    return run


def _pairs(chunks: DataFrame, cosine: float) -> DataFrame:
    """Each two chunks (and each with itself) once, unless their boxes are too far apart: a product of partitions, for which no row is copied to disk."""
    count = chunks.count()
    parts = max(1, min(count, max(math.isqrt(partitions(chunks)), -(-count // HELD))))
    dealt = chunks.repartition(parts)
    one, two = (dealt.select(*(F.col(c).alias(f"{side}_{c}") for c in chunks.columns)) for side in "lr")
    gap = "greatest(0D, l_lo[k] - r_hi[k], r_lo[k] - l_hi[k])"
    apart = F.expr(f"aggregate(sequence(0, int(l_d) - 1), 0D, (s, k) -> s + {gap} * {gap})")
    once = F.expr("l_id = r_id or (l_id < r_id) = (pmod(xxhash64(l_id) ^ xxhash64(r_id), 2) = 0)")
    met = one.join(two.hint("shuffle_replicate_nl"), F.expr("l_d - r_d = 0") & once & (apart <= (2 - 2 * cosine) * (1 + 1e-6) + 1e-9))
    return met.select("l_id", "r_id", "l_d", "l_nodes", "l_copies", "l_raws", "r_nodes", "r_copies", "r_raws")


def near_vectors(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Pairs of vectors of one length with a cosine of at least `cosine` (in doubles) are linked; equal vectors are one
    node with its number of copies. Tasks give each node's links and a spanning forest, never all pairs.
    Vectors that are null, empty, zero or hold null or non-finite values link with nothing. A row with a null id links like
    others but is a component_id only where no other id is there (null, and kept is false); repeated rows stay.
    """
    spark = vecs.sparkSession
    single = vecs.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = save(
        vecs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v")).mapInArrow(_nodes(kind), "vec_id long, node binary, raw binary")
    )
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("raw").alias("raw"))
    nodes = save(nodes.select("node", "copies", "raw").mapInArrow(_cells(kind), "d long, cell long, node binary, copies long, raw binary"))
    ranged = nodes.repartitionByRange(max(1, -(-nodes.count() // (8 * CHUNK))), "d", "cell", "node").sortWithinPartitions("d", "cell", "node")
    chunks = ranged.select("d", "node", "copies", "raw").mapInArrow(_pack(kind), "d long, nodes binary, copies binary, raws binary, lo array<double>, hi array<double>")
    chunks = save(chunks.withColumn("id", F.monotonically_increasing_id()))
    drop(nodes)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "4")  # rows are pairs of chunks here
    try:
        found = save(_pairs(chunks, cosine).mapInArrow(_compare(cosine, kind), "u binary, v binary, w long"))
    finally:
        spark.conf.set(BATCH, before)
    drop(chunks)
    roots = connected_components(found.where("v is not null").select("u", "v"))
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("w"))
    copies = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    placed = copies.join(counts, "node", "left").join(roots, "node", "left")
    placed = rows.select("vec_id", "node").join(placed.select("node", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "node").alias("root")), "node", "left")
    least = placed.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x
)
SELECT reach.a AS vec_id, CAST((SELECT count(*) FROM links WHERE x = reach.a) AS BIGINT) AS n_links, min(b) AS component_id, reach.a = min(b) AS kept
FROM reach GROUP BY reach.a
"""
