"""Toxicity by multiple-instance learning: noisy-or of sentence scores, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import NONWORD, U64, _BYTE_VALUES, _power_tables, LOWER, mix, pieces, table, utf8_parts

#: Training: at most this many labelled ids, drawn by a hash of the id; of their texts, none longer than LONGEST bytes, at most
#: twice as many (ids may be repeated) and BYTES in all are brought to the driver.
TEXTS, LONGEST, BYTES = 5_000, 60_000, 100_000_000
#: Hashed features: each word, and its openings of these many bytes.
DIM, OPENINGS = 1 << 19, (4, 5, 6, 7, 8)
STEPS, RATE, SPARSE, START, GAIN, HIDE = 400, 0.05, 1e-4, -12.0, 25.0, 0.6
REJECT = 0.7
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word of rows (a column for the word and each opening, DIM where it is too short), the sentence of
    each word, the row of each sentence with words, and the byte where each such sentence begins."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return np.zeros((0, 1 + len(OPENINGS)), np.int64), none, none, none
    low = LOWER[data]
    inside = ~NONWORD[low]
    edge = np.zeros(n, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    left = inside & (np.concatenate([[True], ~inside[:-1]]) | edge)
    right = inside & np.concatenate([~inside[1:] | edge[1:], [True]])
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[low] * up[:n], out=sums[1:])
    cols = [mix((sums[ends] - sums[starts]) * down[starts] + U64(1)) % U64(DIM)]
    for k in OPENINGS:
        h = mix((sums[np.minimum(starts + k, n)] - sums[starts]) * down[starts] + U64(k << 8)) % U64(DIM)
        cols.append(np.where(ends - starts >= k, h, U64(DIM)))
    breaks = np.cumsum(np.concatenate([[False], _ENDS[data[:-1]]]) | edge)
    cut = breaks[starts]
    fresh = np.concatenate([[True], cut[1:] != cut[:-1]]) if len(cut) else np.zeros(0, bool)
    of = np.cumsum(fresh) - 1
    heads = starts[fresh]
    row = np.searchsorted(offsets, heads, side="right") - 1
    return np.stack(cols, axis=1).astype(np.int64), of, row, heads


class Model:
    """weights has DIM + 1 values, the last 0; a sentence's chance is the logistic of bias plus its words' weights."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feats, of, row, heads = sentences(data, offsets)
        word = np.zeros(len(feats))
        for k in range(feats.shape[1]):
            word += self.weights[feats[:, k]]
        return self.bias + np.bincount(of, word, minlength=len(row)), row, heads

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Noisy-or over the sentences of each row; a row without words has only the bias, as one empty sentence."""
        z, row, _ = self.logits(data, offsets)
        total = np.bincount(row, np.logaddexp(0, z), minlength=len(offsets) - 1)
        empty = np.bincount(row, minlength=len(offsets) - 1) == 0
        total[empty] = np.logaddexp(0, self.bias)
        return -np.expm1(-total)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Projected gradient ascent, with a small L1 pull, on the log-likelihood of the document labels.

    In the first half of the steps some features are hidden, so that each of several signs in a document is learnt;
    the second half lowers those that speak for label 1 too often.
    Steps follow the plain gradient, so features that explain many documents grow first and leave nothing to rarer
    ones. Weights stay at or above 0 and the bias is fixed: a sentence offends because of what it has.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    y = np.array(labels, float)
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        base = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(DIM + 1), float(np.log(base / (1 - base))))

    def parts():
        for a, b in pieces(offsets):
            yield a, sentences(np.frombuffer(b"".join(raw[a:b]), np.uint8), offsets[a : b + 1] - offsets[a])

    # candidates: features that documents with label 1 have more often, beyond chance
    pos, neg = np.zeros(DIM + 1), np.zeros(DIM + 1)
    for a, (feats, of, row, _) in parts():
        pairs = np.unique(feats.ravel() * len(y) + np.repeat(row[of] + a, feats.shape[1]))
        for label, into in ((1, pos), (0, neg)):
            into += np.bincount(pairs[y[pairs % len(y)] == label] // len(y), minlength=DIM + 1)
    both = np.maximum(pos + neg, 1)
    gain = 2 * (pos * np.log(np.maximum(pos, 1) / (both * share)) + neg * np.log(np.maximum(neg, 1) / (both * (1 - share))))
    often = (gain >= GAIN) & (pos > both * share)
    often[DIM] = False
    row, flat, sent = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    before = 0
    for a, (feats, of, at, _) in parts():
        use = often[feats]
        flat.append(feats[use])
        sent.append(np.repeat(of + before, feats.shape[1]).reshape(feats.shape)[use])
        row.append(at + a)
        before += len(at)
    row, flat, sent = map(np.concatenate, (row, flat, sent))
    known, flat = np.unique(flat, return_inverse=True)
    w, bias = np.zeros(len(known)), START
    draw = np.random.default_rng(11)
    for step in range(STEPS):
        late = step >= STEPS // 2
        off = (draw.random(len(known)) < HIDE) & (not late)
        z = bias + np.bincount(sent, np.where(off, 0, w)[flat], minlength=len(row))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(row, np.logaddexp(0, z), minlength=len(y))
        pull = np.where(y == 1, 1 / np.expm1(np.clip(total, 1e-9, 500)), -1.0)
        g = np.bincount(flat, (p * pull[row])[sent], minlength=len(known))
        w = np.where(off, w, np.maximum(w + np.clip(RATE * (g - (0 if late else SPARSE * len(y))), -1, 1), 0))
    weights = np.zeros(DIM + 1)
    weights[known] = w
    return Model(weights, float(bias))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("long").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out; a label that is null counts for nothing, equal rows count once."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TEXTS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= LONGEST)
    texts = texts.join(F.broadcast(drawn), "doc_id").withColumn("h", F.xxhash64("text"))  # at most TEXTS rows
    sizes = texts.groupBy("doc_id", "h").agg(F.max(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(2 * TEXTS).collect()
    chosen, total = [], 0
    for r in sizes:
        total += r.size
        if total <= BYTES:
            chosen.append((r.doc_id, r.h))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long")
    found = texts.join(F.broadcast(chosen), ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.toxic for r in rows])


def toxicity(text: Column, model) -> Column:
    """The chance that each whole text is toxic (0 to 1; null and empty texts have a score too); model is a broadcast Model."""

    @F.arrow_udf("double")
    def score(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            offsets, data = utf8_parts(col)
            got = [model.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
            yield pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())

    return score(text)


SPANS = "array<struct<start:bigint,score:double>>"


def offending(text: Column, model, at_least: float = 0.5) -> Column:
    """Where sentences of at least this chance begin (bytes of the UTF-8 text) and their chances; null texts have none."""

    @F.arrow_udf(SPANS)
    def locate(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            offsets, data = utf8_parts(col)
            out: list[list[dict]] = [[] for _ in range(len(col))]
            for a, b in pieces(offsets):
                z, row, heads = model.value.logits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p = 1 / (1 + np.exp(-z))
                for k in np.flatnonzero(p >= at_least).tolist():
                    r = a + int(row[k])
                    out[r].append({"start": int(heads[k] + offsets[a] - offsets[r]), "score": float(p[k])})
            yield pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())])))

    return locate(text)


def with_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; repeated rows each have a result; a null id stays null and is not held out. Without labels of both kinds the score is the same everywhere; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), toxicity(F.col(text_col).cast("string"), sent).alias("score"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
