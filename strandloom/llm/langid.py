"""Language identification by cross-parsing: the language whose suffix automaton needs the fewest normalised phrases."""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import pieces, table, utf8_parts

#: Training: at most this many labelled texts and symbols of a language, drawn by a hash of the id; longer texts than
#: LONGEST bytes are not drawn. CELLS bounds all tables together, so with many languages (over 4 with 62 letters) each has fewer symbols.
TEXTS, SYMBOLS, LONGEST, CELLS = 120, 40_000, 100_000, 24_000_000
#: What is brought to the driver: the openings of the drawn texts, this many characters in all, of at most so many languages
#: (those with most labelled rows).
CHARACTERS, LANGUAGES = 60_000_000, 1_000
#: Up to ALPHABET letters have a symbol each. Of more, as many as leave room for HEADS and TAILS have one, all others are
#: spelled as a head and one to three tails, enough for every letter there is; a spelling begins nowhere but at its head.
ALPHABET, HEADS, TAILS = 62, 16, 24
#: Texts are parsed in stretches of this many symbols, so that many are parsed in step; see Model.phrases().
STRETCH = 512


def suffix_table(symbols: np.ndarray, size: int) -> np.ndarray:
    """Transitions of the suffix automaton as a table (state, symbol) -> state; 0 is the root and means none."""
    onward, link, length = np.zeros((2 * len(symbols) + 2, size), np.int32), [-1], [0]
    rows: list[dict[int, int]] = [{}]
    last = 0
    for c in symbols.tolist():
        made = len(rows)
        rows.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in rows[p]:
            rows[p][c] = made
            p = link[p]
        if p >= 0:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[made] = q
            else:
                copy = len(rows)
                rows.append(dict(rows[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[made] = copy
                while p >= 0 and rows[p].get(c) == q:
                    rows[p][c] = copy
                    p = link[p]
        last = made
    for k, row in enumerate(rows):
        onward[k, list(row)] = list(row.values())
    return onward[: len(rows)]


def symbol_table(letters: list[str]) -> np.ndarray:
    """Symbols for every code point, a byte each from the lowest: 0 for what is no letter, 1 for a letter that is not listed."""
    out = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint32, 0x110000)
    alone = len(letters) if len(letters) <= ALPHABET else ALPHABET - HEADS - TAILS
    tails = 1
    while HEADS * TAILS**tails < len(letters) - alone:
        tails += 1
    for k, c in enumerate(letters):
        if k < alone:
            spelled = k + 2
        else:
            rest, spelled = k - alone, 0
            for _ in range(tails):
                rest, tail = divmod(rest, TAILS)
                spelled = spelled << 8 | alone + 2 + HEADS + tail
            spelled = spelled << 8 | alone + 2 + rest
        for x in {c, c.upper()}:
            if len(x) == 1:
                out[ord(x)] = spelled
    return out


def symbols_of(raw: bytes, table_: np.ndarray) -> np.ndarray:
    """Letters as symbols, and one 0 for what stands between words."""
    got = table_[np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
    keep = got > 0
    keep[1:] |= got[:-1] > 0
    got = got[keep]
    if not len(got) or got.max() < 256:
        return got.astype(np.uint8)
    each = got.astype("<u4").view(np.uint8).reshape(-1, 4)
    there = each > 0
    there[:, 0] = True
    return each[there]


def in_turn(sizes: list[int], most: int) -> list[int]:
    """How much of each is taken if all give one after another until there are most."""
    out, left = [0] * len(sizes), most
    order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
    for n, k in enumerate(order):
        out[k] = min(sizes[k], left // (len(order) - n))
        left -= out[k]
    return out


_built: dict[str, "Model"] = {}


class Model:
    """Holds the training symbols of each language; the automata are built where they are used, so a broadcast is small."""

    def __init__(self, texts: dict[str, list[str]]):
        counts = Counter(c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha())
        self.letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.langs = sorted(k for k, ts in texts.items() if any(c.isalpha() for t in ts for c in t))
        self.size = min(len(self.letters), ALPHABET) + 2
        most = min(SYMBOLS, CELLS // (2 * self.size * max(1, len(self.langs))))
        known = symbol_table(self.letters)
        self.seqs = []
        for k in self.langs:
            drawn = [symbols_of(t.encode("utf-8", "replace"), known) for t in texts[k]]
            self.seqs.append(np.concatenate([t[:n] for t, n in zip(drawn, in_turn([len(t) for t in drawn], most))]))
        self.key = uuid.uuid4().hex

    def built(self) -> "Model":
        """With the automata; a worker keeps the last model it built."""
        if self.key not in _built:
            self.symbols = symbol_table(self.letters)
            made, self.root, at = [], [], 0
            for seq in self.seqs:
                made.append(suffix_table(seq, self.size))
                made[-1][made[-1] > 0] += at
                self.root.append(at)
                at += len(made[-1])
            self.weight = [math.log2(len(seq) + 1) for seq in self.seqs]
            self.onward = np.concatenate(made).ravel() if made else np.zeros(0, np.int32)
            _built.clear()
            _built[self.key] = self
        return _built[self.key]

    def parse(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each stretch (rows) in each language (columns), and the states after it, from the states before it."""
        order = np.argsort(-size, kind="stable")
        start, size, state = start[order], size[order], state[order]
        roots = np.array(self.root, np.int64)
        count = np.zeros(state.shape, np.int64)
        live = np.searchsorted(-size, -np.arange(STRETCH), side="left")
        for t in range(int(size[0]) if len(size) else 0):
            n = live[t]
            c = flat[start[:n] + t][:, None]
            got = self.onward[state[:n] * self.size + c]
            stuck = got == 0
            if stuck.any():
                again = self.onward[roots * self.size + c]
                count[:n] += stuck.astype(np.int64) + (stuck & (again == 0) & (state[:n] != roots))  # a symbol of no training text is a phrase too
                got = np.where(stuck, np.where(again == 0, roots, again), got)
            state[:n] = got
        back = np.argsort(order)
        return count[back], state[back]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns).

        All stretches are parsed at once as if phrases began with them, and then again from the states that the stretches before
        them leave, until no such state changes: the result is that of a parse from the beginning of each text to its end.
        """
        parts = [-(-len(t) // STRETCH) for t in texts]
        flat = np.concatenate([*texts, np.zeros(0, np.uint8)]).astype(np.int64)
        begins = np.cumsum([0, *map(len, texts)])
        start = np.concatenate([begins[k] + STRETCH * np.arange(n) for k, n in enumerate(parts)] or [np.zeros(0)]).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), parts)
        size = np.minimum(STRETCH, begins[of + 1] - start)
        roots = np.array(self.root, np.int64)
        before = np.tile(roots, (len(start), 1))
        count, after = self.parse(flat, start, size, before)
        inner = np.flatnonzero(start != begins[of])
        while len(inner):
            inner = inner[(after[inner - 1] != before[inner]).any(axis=1)]
            before[inner] = after[inner - 1]
            count[inner], after[inner] = self.parse(flat, start[inner], size[inner], before[inner])
            inner = inner[:0] if not len(inner) else np.flatnonzero(start != begins[of])
        count += (after != roots) & (start + size == begins[of + 1])[:, None]
        out = np.zeros((len(texts), len(roots)), np.int64)
        np.add.at(out, of, count)
        return out

    def guess(self, raws: list[bytes]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(raws), [0.0] * len(raws)
        if not self.langs:
            return langs, scores
        texts = [symbols_of(r, self.symbols) for r in raws]
        some = [k for k, t in enumerate(texts) if t.any()]
        if some:
            cost = self.phrases([texts[k] for k in some]) * np.array(self.weight)
            best = cost.argmin(axis=1)
            least = cost.min(axis=1)
            cost[np.arange(len(some)), best] = np.inf
            margin = 1 - least / cost.min(axis=1) if len(self.langs) > 1 else np.ones(len(some))
            for k, b, m in zip(some, best.tolist(), margin.tolist()):
                langs[k], scores[k] = self.langs[b], m
        return langs, scores


def train(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of rows with a language that are not held out: TEXTS rows of each of LANGUAGES languages and
    CHARACTERS characters of them in all; equal rows count once. The sample is chosen without moving texts."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out & (F.octet_length("text") <= LONGEST)).withColumn("h", F.xxhash64("text"))
    known = d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    langs = [r.lang for r in known.collect()]
    if not langs:
        return Model({})
    known = docs.sparkSession.createDataFrame([(x,) for x in langs], "lang string")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    rows = d.select("lang", "doc_id", "h").join(F.broadcast(known), "lang")  # at most LANGUAGES rows
    drawn = rows.withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= TEXTS).select("lang", "doc_id", "h").distinct()
    most = min(SYMBOLS, max(1, CHARACTERS // (TEXTS * len(langs))))
    cut = F.substring("text", 1, most).alias("text")
    found = d.join(F.broadcast(drawn), ["lang", "doc_id", "h"], "left_semi").groupBy("lang", "doc_id", "h").agg(F.min(cut).alias("text"))  # TEXTS rows for each language
    texts = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.lang, r.doc_id, r.text)):
        texts[r.lang].append(r.text)
    return Model(texts)


GUESS = "struct<lang_pred:string,score:double>"


def language(text: Column, model) -> Column:
    """lang_pred and score (how much cheaper than the next language, 0 to 1) of each whole text; model is a broadcast Model. `und` and 0 without a letter."""

    @F.arrow_udf(GUESS)
    def guess(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value.built()
        for col in cols:
            offsets, data = utf8_parts(col)
            langs, scores = [], []
            for a, b in pieces(offsets):
                got = m.guess([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(a, b)])
                langs += got[0]
                scores += got[1]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return guess(text)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("long").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; repeated rows each have a result; a null id stays null and is neither learnt from nor held out. Without any labelled text all rows are `und`."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, held_out(F.col("doc_id")), id_col, text_col, lang_col))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), language(F.col(text_col).cast("string"), sent).alias("g"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "g.lang_pred", "g.score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
