"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of the test items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import WORD_MAP, table
from strandloom.plans.tables import drop, written as save

WINDOW = 13
#: Words of items in one automaton; larger benchmarks are scanned for in several blocks of this size.
BLOCK_WORDS = 120_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(WORD_MAP).split()


class Windows:
    """The automaton. Every word that an item has is spelt as a fixed number of letters, each place with letters of its
    own, so a node has few children, matches begin at words only, and a match's end gives its word at once."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        import ahocorasick

        rows = [(i, words_of(t)) for i, t in items]
        known = sorted({w for _, ws in rows for w in ws})
        self.places = 2 if len(known) < 2400 else 3
        base = 2
        while base**self.places < len(known) + 1:
            base += 1
        letter = [[chr(0x100 + place * base + k) for k in range(base)] for place in range(self.places)]

        def spell(k: int) -> str:
            out = ""
            for place in range(self.places):
                out += letter[place][k % base]
                k //= base
            return out

        self.other = spell(0)
        self.code = {w: spell(k) for k, w in enumerate(known, 1)}
        found: dict[str, tuple[int, set[str]]] = {}
        for i, ws in rows:
            size = min(window, len(ws))
            for a in range(len(ws) - size + 1 if ws else 0):
                found.setdefault("".join(self.code[w] for w in ws[a : a + size]), (size, set()))[1].update([] if i is None else [i])
        self.automaton = ahocorasick.Automaton()
        for key, (size, owners) in found.items():
            self.automaton.add_word(key, (size, sorted(owners)))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged word spans [a, b) inside occurrences, and the items that have one."""
        spans, items = [], set()
        if not self.any:
            return spans, items
        get, other = self.code.get, self.other
        for end, (size, owners) in self.automaton.iter("".join([get(w, other) for w in words])):
            b = end // self.places + 1
            a = b - size
            while spans and a <= spans[-1][1]:
                p, q = spans.pop()
                a, b = min(a, p), max(b, q)
            spans.append([a, b])
            items.update(owners)
        return spans, items


HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<a:bigint,b:bigint>>,chars:array<struct<a:bigint,b:bigint>>>"
_HITS_PA = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
    ("chars", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
])


def places(text: bytes, spans: list[list[int]]) -> list[dict]:
    """Spans of words, in order, as spans of code points of the text as it was; each part of the text is decoded once."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))]
    edges = [e for a, b in spans for e in (at[a][0], at[b - 1][1])]
    chars, n = [], 0
    for lo, hi in zip([0, *edges], edges):
        n += len(text[lo:hi].decode("utf-8", "ignore"))
        chars.append(n)
    return [{"a": a, "b": b} for a, b in zip(chars[::2], chars[1::2])]


def blocks(items: Iterator[tuple[str | None, str]], most: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str]]]:
    held, size = [], 0
    for i, t in items:
        n = len(words_of(t))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((i, t))
        size += n
    if held:
        yield held


def hits(text: Column, earlier: Column | None, block, window: int = WINDOW) -> Column:
    """What a block of items (a broadcast) has in each whole text, added to what earlier blocks have."""

    key = uuid.uuid4().hex

    def found(texts: pa.Array, before: pa.Array | None) -> list[dict]:
        out = []
        for k, x in enumerate(texts.cast(pa.large_binary())):
            raw = x.as_py() or b""
            words = raw.translate(WORD_MAP).split()
            spans, items = _automaton(block, window, key).scan(words)
            if before is not None:
                old = before[k].as_py()
                items |= set(old["items"])
                spans = merged(spans + [[s["a"], s["b"]] for s in old["spans"]])
            out.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "items": sorted(items), "spans": [{"a": a, "b": b} for a, b in spans], "chars": places(raw, spans)})
        return out

    if earlier is None:

        @F.arrow_udf(HITS)
        def first(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for col in cols:
                yield pa.array(found(col, None), _HITS_PA)

        return first(text)

    @F.arrow_udf(HITS)
    def more(cols: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for col, before in cols:
            yield pa.array(found(col, before), _HITS_PA)

    return more(text, earlier)


_kept: dict = {}


def _automaton(block, window: int, key: str) -> Windows:
    """A worker builds an automaton once and holds only the last one."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = Windows(block.value, window)
    return _kept[key]


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out: str = "hits", window: int = WINDOW) -> DataFrame:
    """docs with a struct column out: n_words, n_hit, items, spans (of words) and chars (of code points of the text as it was).

    The items are gathered in blocks of at most BLOCK_WORDS words (an item of more is one), held by the driver and broadcast
    one at a time; the usual benchmark is one block, and then the texts are scanned once. Of more blocks, the rows with what was
    found so far are written after each, so one automaton is held at a time whatever the size of the benchmark. Null or empty texts
    have no words; null or empty items, and an empty benchmark, have no windows; items of one id are one item; null ids name no
    item but their windows count. A column already named out is replaced; every other column stays.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull())
    seen, result, kept = None, docs.drop(out), None
    for block in blocks(((r[0], r[1]) for r in items.toLocalIterator())):
        if seen is not None:
            now = save(result)
            seen.destroy()
            drop(kept)
            result = kept = now
        before = F.col(out) if seen is not None else None
        seen = spark.sparkContext.broadcast(block)
        result = result.withColumn(out, hits(F.col(text_col).cast("string"), before, seen, window))
    if seen is None:
        result = result.withColumn(out, hits(F.col(text_col).cast("string"), None, spark.sparkContext.broadcast([]), window))
    return result


def contaminated(hit: Column) -> Column:
    """At least one word, and at least a twentieth of the words, inside occurrences of windows."""
    return (hit["n_hit"] > 0) & (20 * hit["n_hit"] >= hit["n_words"])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.col("hits")
    return with_hits(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(h).alias("contaminated"),
    )


OP7_SQL = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), win AS (
  SELECT DISTINCT item, least(len(ws), 13) AS size, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS k
  FROM iw, LATERAL (SELECT unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT size FROM win
), occ AS (
  SELECT doc_id, item, i, win.size FROM dw, sizes, LATERAL (SELECT unnest(range(1, greatest(len(ws) - sizes.size + 2, 1))) AS i)
  JOIN win ON win.size = sizes.size AND win.k = array_to_string(ws[i : i + sizes.size - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY 1
), its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM occ GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
