"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import NONWORD, SPACE, U64, mix, pieces, table, utf8_parts, word_hashes
from strandloom.plans.tables import drop, written as save
from strandloom.plans.components import connected_components

#: Bands and rows of a band: two sets at 0.8 miss every bucket with probability (1 - 0.8^5)^40, about 1e-7.
BANDS, ROWS = 40, 5
SHINGLE, SIMILAR = 5, 80
#: Members of a block, where a bucket has to be looked through.
BLOCK = 800
_MUL = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, between: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its k-word shingles; fewer words make one shingle, none make none."""
    words, at = word_hashes(data, offsets, between)
    n = len(words)
    grams = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        grams += words[j : j + len(grams)] * _MUL[j]
    grams = mix(grams)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * _MUL[: b - a]).sum(dtype=U64) + U64(b - a)], U64))
        else:
            yield np.zeros(0, U64)


class Signer:
    """One hash per shingle, the smallest of each of n bins, and optimal densification: an empty bin takes the value of the first filled bin in its own fixed random order."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows, self.n = bands, rows, bands * rows
        draw = np.random.default_rng(seed)
        self.donors = np.argsort(draw.random((self.n, self.n)), axis=1).astype(np.int32)
        self.mul = mix(np.arange(100, 100 + rows, dtype=U64)) | U64(1)
        self.tag = mix(np.arange(1000, 1000 + bands, dtype=U64))

    def bins(self, s: np.ndarray) -> np.ndarray:
        which = ((s >> U64(32)) * U64(self.n)) >> U64(32)
        first = np.flatnonzero(np.diff(which.astype(np.int64), prepend=-1))
        out, filled = np.zeros(self.n, U64), np.zeros(self.n, bool)
        filled[which[first]] = True
        out[which[first]] = s[first]
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.donors[empty]
            out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        return out

    def buckets(self, s: np.ndarray) -> np.ndarray:
        v = (mix(self.bins(s)).reshape(self.bands, self.rows) * self.mul).sum(axis=1, dtype=U64)
        return mix(v + self.tag).view(np.int64)


def set_id(s: np.ndarray) -> bytes:
    """128 bits that stand for a set: equal sets are one node."""
    return np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)], U64).byteswap().tobytes()


def _sign(k: int, word: str):
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            offsets, data = utf8_parts(batch.column(1))
            for a, b in pieces(offsets):
                lo, hi = offsets[a], offsets[b]
                n, node, bands = [], [], []
                for s in shingle_sets(data[lo:hi], offsets[a : b + 1] - lo, k, _BETWEEN[word]):
                    n.append(len(s))
                    node.append(set_id(s) if len(s) else None)
                    bands.append(signer.buckets(s) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, bands)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(2)[a:b], pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands))),
                ], schema=schema)

    return run


_BETWEEN = {"space": SPACE, "word": NONWORD}


def _confirm(k: int, word: str, similar: int):
    """(u, v) of stars that hold: rows (hub, salt, node, text) come by hub and salt, the hub's own text first (node null)."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            offsets, data = utf8_parts(batch.column(3))
            for a, b in pieces(offsets, 1_000_000):
                keep = np.zeros(b - a, bool)
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, _BETWEEN[word])
                hub = batch.column(2)[a:b].is_null().to_numpy(zero_copy_only=False)
                for i, s in enumerate(sets):
                    if hub[i]:
                        own = s
                    else:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        keep[i] = 100 * both >= similar * (len(own) + len(s) - both)
                yield pa.RecordBatch.from_arrays([batch.column(c)[a:b].filter(pa.array(keep)) for c in (0, 2)], schema=schema)

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, word: str, similar: int) -> DataFrame:
    """Those stars (hub u, node v) whose full shingle sets are similar enough.

    The members of a hub are dealt out in groups of about BLOCK, and a hub's text goes to each group once, not to each member.
    """
    sizes = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))
    members = pairs.join(sizes.hint("merge"), "u").select("u", F.pmod(F.xxhash64("v"), F.col("many")).cast("int").alias("salt"), F.col("v").alias("node"))
    members = members.hint("merge").join(texts, "node").select("u", "salt", "node", "text")
    hubs = sizes.hint("merge").join(texts.withColumnRenamed("node", "u"), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("salt"), F.lit(None).cast("binary").alias("node"), "text")
    both = members.unionByName(hubs).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("node").asc_nulls_first())
    return both.mapInArrow(_confirm(k, word, similar), "u binary, v binary")


def common_counts(ones: list[np.ndarray], twos: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[int]:
    """Sizes of the intersections of pairs of sorted sets: pair by pair, or for many pairs by products of 0/1 matrices, a slice of columns at a time."""
    total = sum(map(len, ones)) + sum(map(len, twos))
    if sum(len(ones[i]) + len(twos[j]) + 300 for i, j in pairs) < 3 * total + len(ones) * len(twos) * total / 1000:
        return [len(np.intersect1d(ones[i], twos[j], assume_unique=True)) for i, j in pairs]
    col = np.unique(np.concatenate([*ones, *twos]), return_inverse=True)[1]
    row = np.repeat(np.arange(len(ones) + len(twos)), [*map(len, ones), *map(len, twos)])
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((len(ones), len(twos)), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, 8192):
        lo, hi = np.searchsorted(col, [a, a + 8192])
        dense = np.zeros((len(ones) + len(twos), 8192), np.float32)
        dense[row[lo:hi], col[lo:hi] - a] = 1
        out += dense[: len(ones)] @ dense[len(ones) :].T
    return [int(out[i, j]) for i, j in pairs]


def _open_pairs(k: int, word: str, similar: int):
    """Links inside blocks of a bucket between sets of different components; a pair is looked at in the first bucket it shares."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def within(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        bucket, lo, hi = rows[0][:3]
        x = [r for r in rows if r[3] == lo]
        y = x if lo == hi else [r for r in rows if r[3] == hi]
        if not x or not y:
            return []
        bx, by = np.array([r[6] for r in x]), np.array([r[6] for r in y])
        roots = np.array([r[5] for r in y], object)
        pairs = []
        for i in range(len(x)):
            same = bx[i] == by
            first = by[np.arange(len(y)), same.argmax(axis=1)] == bucket
            apart = first & same.any(axis=1) & (roots != x[i][5])
            if lo == hi:
                apart[: i + 1] = False
            pairs += [(i, j) for j in np.flatnonzero(apart).tolist()]
        if not pairs:
            return []
        sets: dict[bytes, np.ndarray] = {}

        def of(r: tuple) -> np.ndarray:
            if r[4] not in sets:
                data = np.frombuffer(r[7], np.uint8)
                sets[r[4]] = next(iter(shingle_sets(data, np.array([0, len(data)]), k, _BETWEEN[word])))
            return sets[r[4]]

        ones, twos = list(dict.fromkeys(i for i, _ in pairs)), list(dict.fromkeys(j for _, j in pairs))
        at, to = {i: a for a, i in enumerate(ones)}, {j: a for a, j in enumerate(twos)}
        both = common_counts([of(x[i]) for i in ones], [of(y[j]) for j in twos], [(at[i], to[j]) for i, j in pairs])
        out = []
        for (i, j), n in zip(pairs, both):
            if 100 * n >= similar * (len(of(x[i])) + len(of(y[j])) - n):
                out.append((x[i][4], y[j][4]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            bands = batch.column(6).flatten().to_numpy().reshape(len(batch), -1)
            texts = batch.column(7).cast(pa.large_binary())
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:6]), bands, (t.as_buffer() for t in texts)):
                if held and held[0][:3] != row[:3]:
                    found += within(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], schema=schema)
        if held:
            found = within(held)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], schema=schema)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similar: int = SIMILAR, word: str = "space", keyed: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows whose k-word shingle sets have 100 * intersection >= similar * union are linked; component_id is the
    smallest id reachable. Exact copies (equal sets) are one node from the start. Candidates are stars: in every
    bucket the node that meets most others over all buckets is the hub and is compared with each other member, so a
    bucket of m members gives m - 1 pairs. Buckets whose other members are still in different components are then
    looked through in blocks of about BLOCK members, so no link inside a bucket is lost and no pairs are shuffled.
    All links are confirmed on full sets, made again from the whole texts.

    Null or empty texts have no shingles and link with nothing. Rows with a null id link like others but are never a
    component_id unless no other id is there (then it is null, and kept is false); repeated rows stay, each with
    its own result. Other columns of the input are not read. With keyed, also h (the hash of the text) and root (the
    group, also of null ids only; null without shingles).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    rows = save(docs.select("doc_id", "text", "h").mapInArrow(_sign(k, word), "doc_id long, h long, n long, node binary, bands array<long>"))
    nodes = rows.where("n > 0").dropDuplicates(["node"])
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = save(spread.join(shared, "bucket").select("bucket", "node", "n", "m"))
    weight = shared.groupBy("node").agg(F.sum("m").alias("w"))
    hubs = shared.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("w", "node", "n")).alias("hub"))
    starred = save(shared.join(hubs, "bucket").select("bucket", "node", "n", "m", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    drop(shared)
    near = lambda a, b: 100 * F.least(a, b) >= similar * F.greatest(a, b)
    stars = save(starred.where(F.col("node") != F.col("hub")).where(near(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct())
    inside = stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))).distinct()

    def texts(wanted: DataFrame) -> DataFrame:
        found = rows.where("n > 0").join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("h", "doc_id")).alias("at"))
        found = found.select("node", F.col("at.h").alias("h"), F.col("at.doc_id").alias("d"))
        same = docs.join(found, (docs["h"] == found["h"]) & docs["doc_id"].eqNullSafe(found["d"])).select("node", "text")
        return same.groupBy("node").agg(F.first("text").alias("text"))  # repeated rows give a node one text

    chosen = save(texts(inside))
    links = save(_links(stars, chosen, k, word, similar).distinct())
    roots = connected_components(links)
    members = starred.where("m > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = members.where("node <> hub").groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("bucket", "size")
    members = save(members.where("node <> hub").join(mixed, "bucket").select("bucket", "node", "root", "size"))
    if not members.isEmpty():
        bands = nodes.select("node", "bands").join(members.select("node").distinct(), "node", "left_semi")
        open_texts = save(texts(members.select("node").distinct()).join(bands, "node"))
        many = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
        dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root")
        groups = dealt.join(open_texts, "node").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
        rest = groups.select("bucket", "lo", "hi", "own", "node", "root", "bands", "text").mapInArrow(_open_pairs(k, word, similar), "u binary, v binary")
        links = save(links.unionByName(rest).distinct())
        roots = connected_components(links)
        drop(open_texts)
    drop(members)
    drop(starred)
    drop(chosen)
    placed = rows.select("doc_id", "h", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), *(["h", "root"] if keyed else []))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, similar=SIMILAR)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w
), ex AS (SELECT doc_id, unnest(s) AS g FROM sh
), ex2 AS (SELECT doc_id, g FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM ex) WHERE c > 1
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM ex2 a JOIN ex2 b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sh p ON p.doc_id = x JOIN sh q ON q.doc_id = y
  WHERE 100 * inter >= 80 * (len(p.s) + len(q.s) - inter)
), sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.y FROM reach r JOIN sym s ON r.b = s.x
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT sh.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sh.doc_id = component_id AS kept
FROM sh JOIN comp ON comp.doc_id = sh.doc_id
"""
