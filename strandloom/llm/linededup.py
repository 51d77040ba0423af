"""Repeated passages by winnowing: window minima of hashed word runs are fingerprints, their positions are joined, matches
are extended both ways and later repeats are cut out.

Lines are no help where a repeated passage begins inside one, so what is hashed are runs of GRAM words across lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import SPACE, U64, free_name, mix, pieces, table, utf8_parts, word_hashes, word_starts
from strandloom.plans.tables import drop, written as save

#: Any run of REPEAT words that stands twice shares a fingerprint: REPEAT = GRAM + window - 1.
REPEAT, GRAM = 50, 16
#: Words of the runs that occurrences are grouped by, round after round; each two of the next size cover what holds one before.
SIZES = (GRAM, 33, REPEAT)
WIDTH = REPEAT - GRAM + 1
_NO_ID = 9223372036854775807
_STEP, _BITS = 0x9E3779B97F4A7C15, 24


_steps = [np.ones(1, U64), np.ones(1, U64)]


def _step_tables(n: int) -> list[np.ndarray]:
    if len(_steps[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            all_ = np.full(n, base, U64)
            all_[0] = 1
            _steps[i] = np.cumprod(all_, dtype=U64)
    return _steps


def fingerprints(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position) of each selected run: the smallest of some WIDTH runs in a row, of equal ones the last."""
    n = len(words) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none
    up, down = _step_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:n]) * down[:n])
    pos = np.arange(n, dtype=U64)
    least = (grams >> U64(_BITS) << U64(_BITS)) | (U64((1 << _BITS) - 1) - (pos & U64((1 << _BITS) - 1)))
    size = 1
    while size < WIDTH:
        step = min(size, WIDTH - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    starts = np.arange(len(least))
    row = np.searchsorted(at, starts, side="right") - 1
    inside = starts + REPEAT <= at[row + 1]
    low = U64((1 << _BITS) - 1) - (least[inside] & U64((1 << _BITS) - 1))
    first = starts[inside]
    chosen = np.unique(first + ((low.astype(np.int64) - first) & ((1 << _BITS) - 1)))
    row = np.searchsorted(at, chosen, side="right") - 1
    return grams[chosen].view(np.int64), row, chosen - at[row]


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8_parts(batch.column(1))
        for a, b in pieces(offsets):
            words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACE)
            fp, row, pos = fingerprints(words, at)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), batch.column(0)[a:b].take(row), batch.column(2)[a:b].take(row), pa.array(pos.astype(np.int32))], names=["key", "doc", "h", "pos"])


class Sums:
    """A text's words and prefix sums, by which any two runs of words are compared at once. Texts of one table share its sums: text is where its words begin in them."""

    def __init__(self, words: np.ndarray, sums: np.ndarray, first: int, end: int):
        self.words, self.n, self.first, self.sums = words[first:end], end - first, first, sums[first : end + 1]

    def keys(self, a: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the runs of size words from a on."""
        return mix((self.sums[a + size] - self.sums[a]) * _steps[1][self.first + a] + U64(size)).view(np.int64)

    def equal(self, a: np.ndarray, other: Sums, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        mine, theirs = self.sums[a + size] - self.sums[a], other.sums[b + size] - other.sums[b]
        ahead = other.first + b - self.first - a
        return mine * _steps[0][np.maximum(ahead, 0)] == theirs * _steps[0][np.maximum(-ahead, 0)]


def texts_of(column: pa.Array) -> Iterator[Sums]:
    """The Sums of each text, hashed together for about as many bytes as pieces() takes; equal neighbours are hashed once."""
    offsets, data = utf8_parts(column)
    lengths = np.diff(offsets)
    new = np.ones(len(lengths), bool)
    for k in np.flatnonzero(lengths[1:] == lengths[:-1]).tolist():
        new[k + 1] = not np.array_equal(data[offsets[k] : offsets[k + 1]], data[offsets[k + 1] : offsets[k + 2]])
    own = np.flatnonzero(new)
    times = np.diff(np.append(own, len(lengths)))
    column = column if new.all() else column.take(pa.array(own))
    offsets, data = utf8_parts(column)
    at = 0
    for a, b in pieces(offsets):
        words, begins = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACE)
        up, _ = _step_tables(len(words) + 1)
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        begins = begins.tolist()
        for k in range(b - a):
            text = Sums(words, sums, begins[k], begins[k + 1])
            for _ in range(times[at]):
                yield text
            at += 1


def reach(t: Sums, p: np.ndarray, s: Sums, q: np.ndarray, sign: int) -> np.ndarray:
    """How many words from p and q on (sign 1), or before them (-1), are equal."""
    lo, hi = np.zeros(len(p), np.int64), np.minimum(t.n - p, s.n - q) if sign > 0 else np.minimum(p, q)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = t.equal(p, s, q, mid) if sign > 0 else t.equal(p - mid, s, q - mid, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def match(t: Sums, p: np.ndarray, s: Sums, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words before and from p and q: along whole diagonals where they are few, else by reach()."""
    off = p - q
    lines = off[:1] if (off == off[:1]).all() else np.unique(off)
    if len(lines) > 8:
        return reach(t, p, s, q, -1), reach(t, p, s, q, 1)
    left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    for d in lines.tolist():
        a, b = max(d, 0), min(t.n, s.n + d)
        breaks = np.concatenate([[a - 1], a + np.flatnonzero(t.words[a:b] != s.words[a - d : b - d]), [b]])
        at = np.flatnonzero(off == d)
        after = np.searchsorted(breaks, p[at])
        left[at], right[at] = p[at] - breaks[after - 1] - 1, breaks[after] - p[at]
    return left, right


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_RUNS_SQL = "array<struct<a:bigint,b:bigint>>"
_OPEN = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())]))
_OPEN_SQL = "array<struct<key:bigint,pos:int>>"


def undecided(p: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, size: int, longer: int) -> np.ndarray:
    """Starts of runs of `longer` words that hold the run of `size` words at p and lie in a window of REPEAT words that the match [p - left, p + right) does not hold.

    Any such window holds the first or the last of these runs, or is one of them.
    """
    starts = p[:, None] - (np.array([0, longer - size]) if longer < REPEAT else np.arange(longer - size + 1))
    # windows around a run begin from start + longer - REPEAT to start
    first, last = np.maximum(starts + longer - REPEAT, 0), np.minimum(starts, n - REPEAT)
    outside = (first < (p - left)[:, None]) | (last + REPEAT > (p + right)[:, None])
    return np.unique(starts[(first <= last) & outside])


def _extend(size: int, longer: int | None):
    """doc, h, runs and open: the later repeats in a text of what an earlier place has, and the (key, pos) of longer runs that
    other places may share; equal neighbours are hashed once."""
    schema = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("runs", _RUNS), ("open", _OPEN)])

    def lists(counts: list[int], kind: pa.DataType, *fields: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.StructArray.from_arrays(fields, names=[f.name for f in kind.value_type])).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            rows, found, runs, keys, starts = [], [], [], [none], [none]
            places = batch.column(2)
            ends = places.offsets.to_numpy()
            ps, qs = (places.values.field(x).to_numpy().astype(np.int64) for x in (0, 1))
            for k, (t, s) in enumerate(zip(texts_of(batch.column(3)), texts_of(batch.column(4)))):
                p, q = ps[ends[k] : ends[k + 1]], qs[ends[k] : ends[k + 1]]
                fits = (p + size <= t.n) & (q + size <= s.n)
                if not fits.all():
                    p, q = p[fits], q[fits]
                left, right = match(t, p, s, q)
                same = right >= size
                if not same.all():
                    p, right, left = p[same], right[same], left[same]
                if not len(p):
                    continue
                long = left + right >= REPEAT
                more = undecided(p, left, right, t.n, size, longer) if longer else none
                whole = union(list(zip((p - left)[long].tolist(), (p + right)[long].tolist())))
                rows.append(k)
                found.append(len(whole))
                runs += whole
                starts.append(more)
                keys.append(t.keys(more, longer) if len(more) else none)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(1).take(at), lists(found, _RUNS, *(pa.array([r[x] for r in runs], pa.int64()) for x in (0, 1))),
                lists([len(x) for x in starts[1:]], _OPEN, pa.array(np.concatenate(keys)), pa.array(np.concatenate(starts).astype(np.int32))),
            ], schema=schema)

    return run


def cut(raw: bytes, starts: np.ndarray, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text, whose words begin at starts, without these word runs (a run goes with the white space after it), and words cut."""
    edges = np.append(starts, len(raw))
    out, at, gone = [], 0, 0
    for a, b in runs:
        out.append(raw[at : edges[a]])
        at, gone = int(edges[b]), gone + b - a
    out.append(raw[at:])
    joined = b"".join(out)
    return (joined.rstrip() if gone else joined), gone


CUT = "struct<text:string,n_words:bigint,n_removed:bigint>"


def without_runs(text: Column, runs: Column) -> Column:
    """The struct CUT of each text, given lists of lists of word runs (null: none)."""

    @F.arrow_udf(CUT)
    def apply(text: pa.Array, runs: pa.Array) -> pa.Array:
        offsets, data = utf8_parts(text)
        n_words, removed = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        cuts: list[str] = []
        some = runs.is_valid().to_numpy(zero_copy_only=False) & text.is_valid().to_numpy(zero_copy_only=False)
        for a, b in pieces(offsets):
            starts, at = word_starts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SPACE)
            n_words[a:b] = np.diff(at)
            for k in (a + np.flatnonzero(some[a:b])).tolist():
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                own = starts[at[k - a] : at[k - a + 1]] - (offsets[k] - offsets[a])
                kept, removed[k] = cut(raw, own, union([(y["a"], y["b"]) for z in runs[k].as_py() for y in z]))
                cuts.append(kept.decode("utf-8", "replace"))
        try:
            whole = text.cast(pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            whole = pa.array([None if x is None else x.decode("utf-8", "replace") for x in text.cast(pa.large_binary()).to_pylist()], pa.string())
        if cuts:
            whole = pc.replace_with_mask(whole, pa.array(some), pa.array(cuts, pa.string()))
        return pa.StructArray.from_arrays([whole, pa.array(n_words), pa.array(removed)], names=["text", "n_words", "n_removed"])

    return apply(text, runs)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, h, runs) of docs (doc, text, h): in each text, runs of at least REPEAT words that stand at an earlier (doc, h, word) place too.

    A document is a pair of doc and h, the hash of its text; equal rows are one. Every occurrence of a fingerprint is compared
    with its first one. A window of REPEAT words that this match doesn't hold may still stand at another earlier place, so
    runs of more words around the fingerprint are grouped next, and last the windows themselves: three rounds, and in each the
    pairs grow with the occurrences, never with their squares. First places are minima taken before rows are dealt out, and are
    written, so that the joins with them are between plain tables and a hot key is split.
    """
    doc = ["doc", "h"]
    again = save(docs.select("doc", "text", "h").mapInArrow(_select, "key long, doc long, h long, pos int"))
    # most fingerprints stand once: they are counted as plain numbers, and only the others are put in order
    often = again.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    every, again = again, save(again.join(often.hint("merge"), "key", "left_semi"))
    drop(every)
    found, made = [], [again]
    held = None
    for size, longer in zip(SIZES, (*SIZES[1:], None)):
        first = again.groupBy("key").agg(F.min(F.struct("doc", "h", "pos")).alias("at"), F.max(F.struct("doc", "h", "pos")).alias("to")).where("at <> to")
        first = save(first.select("key", F.col("at.doc").alias("s"), F.col("at.h").alias("sh"), F.col("at.pos").alias("q")))
        later = again.join(first.hint("merge"), "key").where("doc <> s or h <> sh or pos > q")
        pairs = save(later.groupBy(*doc, "s", "sh").agg(F.collect_set(F.struct(F.col("pos").alias("p"), "q")).alias("places")))
        if held is None:
            # texts are always dealt by sorted joins: alike at every size, and never with a broadcast of what grows
            wanted = pairs.select(*doc).unionByName(pairs.select(F.col("s").alias("doc"), F.col("sh").alias("h"))).distinct()
            held = save(docs.join(wanted.hint("merge"), doc, "left_semi").groupBy(*doc).agg(F.first("text").alias("text")))
        # both joins take the same columns of the texts, so that they are dealt out once
        both = pairs.hint("merge").join(held.select(*doc, F.col("text").alias("tt")), doc).join(held.select(F.col("doc").alias("s"), F.col("h").alias("sh"), F.col("text").alias("ts")).hint("merge"), ["s", "sh"])
        step = save(both.select(*doc, "places", "tt", "ts").mapInArrow(_extend(size, longer), f"doc long, h long, runs {_RUNS_SQL}, open {_OPEN_SQL}"))
        drop(first, pairs)
        found.append(step.where("size(runs) > 0").select(*doc, "runs"))
        made.append(step)
        if longer:
            again = step.select(*doc, F.explode("open").alias("o")).select("o.key", *doc, "o.pos")
    out = save(reduce(DataFrame.unionByName, found).groupBy(*doc).agg(F.collect_list("runs").alias("runs")))
    drop(held, *made)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "cut") -> DataFrame:
    """docs with a struct column out (text, n_words, n_removed): the text without later repeats.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. A run of at least REPEAT words goes where it stands at an earlier place
    (a smaller id, null ids last; of one id or none, the text of the smaller hash; or before it in the same text); shorter repeats
    stay. Rows of one id and text are one document and keep the same; an emptied text is ''. Null texts stay null with no words;
    texts of fewer than REPEAT words stay. A column already named out is replaced; every other column stays, whatever its name.
    """
    d = docs.drop(out)
    doc, h, runs = (free_name(d, x) for x in ("_doc", "_h", "_runs"))
    d = d.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))).withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    found = repeated_runs(d.select(F.col(doc).alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(h).alias("h")))
    joined = d.join(found.select(F.col("doc").alias(doc), F.col("h").alias(h), F.col("runs").alias(runs)).hint("merge"), [doc, h], "left")
    return joined.withColumn(out, without_runs(F.col(text_col).cast("string"), F.col(runs))).drop(doc, h, runs)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "cut.text", "cut.n_words", "cut.n_removed")
