"""Token counts, BPE encoding and decoding for a tokenizers file with word-end BPE.

White space of ASCII ends every pre-token of such a file, so texts are cut there first, and inside a cut (a chunk) the
file's own normaliser and pre-tokenizer decide. Counting works on each distinct pre-token of all documents once; encoding
on each distinct chunk of many documents.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table
from strandloom.plans.tables import written as save

#: Distinct chunks a worker remembers between batches; past it the memory is cleared, and chunks are counted anew.
REMEMBER = 150_000
NO_RANK = np.iinfo(np.int64).max


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Merger:
    """BPE of many words at once: their symbols lie in one flat array, and each round merges every word's lowest-ranked pair."""

    def __init__(self, path: str):
        self.lib = _library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.end = model["end_of_word_suffix"] or ""
        self.marks = [x.encode() for x in self.special]
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.size
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)[order]

        # the byte alphabet: printable bytes stand for themselves, the others follow 255 in order
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.letters = np.array([self.vocab.get(self.alphabet[b], -1) for b in range(256)], np.int64)
        self.last = np.array([self.vocab.get(self.alphabet[b] + self.end, -1) for b in range(256)], np.int64)
        self.back = {c: b for b, c in self.alphabet.items()}
        steps, cuts = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        kinds = [x["type"] for x in steps.get("normalizers", [])], [x["type"] for x in cuts.get("pretokenizers", [])]
        usual = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and cuts["pretokenizers"][0]["invert"]
        self.pattern = regex.compile(cuts["pretokenizers"][0]["pattern"]["Regex"]) if usual else None

    def pretokens(self, chunks: list[bytes]) -> tuple[list[str], list[int]]:
        """The pre-tokens of chunks without special strings, and how many each chunk has.

        In chunks of letters that NFC leaves alone (below U+0250) lower-casing and the file's own pattern are enough;
        the others go through the library's normaliser and pre-tokenizer.
        """
        words: list[str] = []
        counts: list[int] = []
        for c in chunks:
            text = c.decode("utf-8", "replace")
            if self.pattern and (text.isascii() or max(text) < "\u0250"):
                got = self.pattern.findall(text.lower())
            else:
                plain = self.lib.normalizer.normalize_str(text) if self.lib.normalizer else text
                got = [bytes(map(self.back.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(plain)]
            words += got
            counts.append(len(got))
        return words, counts

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        joined = "".join(words)
        raw = np.frombuffer(joined.encode("utf-8", "surrogateescape"), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if len(raw) != len(joined):
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            wide = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + ((code >= 0x800) & ~((code >= 0xDC80) & (code <= 0xDCFF))) + (code >= 0x10000) - ((code >= 0xDC80) & (code <= 0xDCFF)))])
            ends = np.cumsum(sizes)
            sizes = wide[ends] - wide[ends - sizes]
        sym = self.letters[raw]
        tails = np.cumsum(sizes)[sizes > 0] - 1
        sym[tails] = self.last[raw[tails]]
        name = np.repeat(np.arange(len(words)), sizes)[sym >= 0]
        sym = sym[sym >= 0]
        rank, made = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int64)

        def look(at: np.ndarray) -> None:
            """Find the pairs that begin at these places anew."""
            here = at[at + 1 < len(sym)]
            rank[at] = NO_RANK
            here = here[name[here] == name[here + 1]]
            key = sym[here] * self.size + sym[here + 1]
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            hit = self.keys[k] == key
            rank[here[hit]], made[here[hit]] = self.ranks[k[hit]], self.made[k[hit]]

        look(np.arange(len(sym)))
        ready, owners = [], []
        while len(sym):
            fresh = np.empty(len(sym), bool)
            fresh[0], fresh[1:] = True, name[1:] != name[:-1]
            starts = np.flatnonzero(fresh)
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(sym)))
            done = best == NO_RANK
            ready.append(sym[done])
            owners.append(name[done])
            pos = np.flatnonzero((rank == best) & ~done)
            run = np.flatnonzero(np.diff(pos, prepend=-2) != 1)  # of pairs that overlap, every other one
            pos = pos[(np.arange(len(pos)) - np.repeat(run, np.diff(run, append=len(pos)))) % 2 == 0]
            sym[pos] = made[pos]
            keep = ~done
            keep[pos + 1] = False
            now = (np.cumsum(keep) - 1)[pos]
            sym, name, rank, made = sym[keep], name[keep], rank[keep], made[keep]
            touched = np.zeros(len(sym), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            look(np.flatnonzero(touched))
        owner = np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([*ready, np.zeros(0, np.int64)])[order], np.bincount(owner, minlength=len(words))

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """For each chunk its ids as little-endian unsigned 32-bit integers."""
        odd = [k for k, c in enumerate(chunks) if any(x in c for x in self.marks)]
        whole = chunks if not odd else [b"" if any(x in c for x in self.marks) else c for c in chunks]
        words, has = self.pretokens(whole)
        ids, counts = self.merge(words)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(has, dtype=np.int64)].tolist()
        raw = ids.astype("<u4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        for k in odd:
            out[k] = b"".join(
                self.special[p].to_bytes(4, "little") if p in self.special else self.encode([p.encode()])[0]
                for p in self.cut.split(chunks[k].decode("utf-8", "replace"))
                if p
            )
        return out


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    return Merger(path)


def _texts(col: pa.Array) -> Iterator[bytes]:
    for x in col.cast(pa.large_binary()):
        yield x.as_py() or b""


class Memory(dict):
    """What is known of each chunk; make(list of new chunks) gives their values."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def learn(self, words: set[bytes]) -> None:
        if len(self) > REMEMBER:
            self.clear()
        new = list(words.difference(self))
        for a in range(0, len(new), 10_000):
            some = new[a : a + 10_000]
            self.update(zip(some, self.make(some)))


_memories: dict[tuple[str, str], Memory] = {}


def _memory(kind: str, path: str, make) -> Memory:
    """A worker keeps one memory from task to task."""
    if (kind, path) not in _memories:
        _memories.clear()
        _memories[kind, path] = Memory(make)
    return _memories[kind, path]


def _groups(texts: Iterator[bytes], at_most: int = 2_000_000) -> Iterator[list[list[bytes]]]:
    """The chunks of some texts at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t.split())
        size += len(t)
        if size > at_most:
            yield held
            held, size = [], 0
    if held:
        yield held


#: Documents whose pre-token frequencies are laid down together: about this many bytes of text, and fewer documents than 16 bits count.
BLOCK_BYTES, BLOCK_DOCS = 16_000_000, 65_000
#: Entries (a pre-token in a document) in a row of frequencies, and results a task holds before it hands them out.
ENTRIES = 500_000

_IDS = pa.list_(pa.int64())
_LAID = pa.schema([("block", pa.int64()), ("k", pa.int32()), ("pieces", pa.binary()), ("odd", pa.bool_()), ("data", pa.binary()), ("ids", _IDS), ("sizes", _IDS)])
_LAID_SQL = "block long, k int, pieces binary, odd boolean, data binary, ids array<long>, sizes array<long>"
_PIECES = pa.schema([("piece", pa.binary()), ("odd", pa.bool_()), ("block", pa.int64()), ("k", pa.int32())])
_COUNTED = pa.schema([("block", pa.int64()), ("counts", pa.binary())])
_SUMS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _pack(*parts: np.ndarray) -> bytes:
    raw = b"".join(p.tobytes() for p in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class Block:
    """The pre-token frequencies of some documents."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.known: dict[bytes, int] = {}
        self.flat: list[np.ndarray] = []
        self.bytes = 0

    def add(self, id_: int | None, text: bytes) -> None:
        known = self.known
        words = np.fromiter((known.setdefault(w, len(known)) for w in text.split()), np.int64)
        self.flat.append(words << 16 | len(self.ids))
        self.ids.append(id_)
        self.sizes.append(len(text))
        self.bytes += len(text)

    def entries(self, m: Merger) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
        """The distinct pre-tokens, the chunks with special strings in them (kept whole, numbered after), and the entries: number << 16 | document, and how often."""
        chunks = list(self.known)
        key, times = np.unique(np.concatenate(self.flat), return_counts=True)
        chunk, at = key >> 16, key & 0xFFFF
        odd = np.fromiter((any(x in c for x in m.marks) for c in chunks), bool, len(chunks))
        words, has = m.pretokens([b"" if o else c for o, c in zip(odd.tolist(), chunks)])
        number: dict[str, int] = {}
        piece = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        has = np.array(has, np.int64)
        start, reps = np.cumsum(has) - has, has[chunk]
        place = np.repeat(start[chunk] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        alone = odd[chunk]
        whole = len(number) + np.cumsum(odd) - 1
        key = np.concatenate([piece[place] << 16 | np.repeat(at, reps), whole[chunk[alone]] << 16 | at[alone]])
        times = np.concatenate([np.repeat(times, reps), times[alone]])
        key, same = np.unique(key, return_inverse=True)
        return [w.encode("utf-8", "surrogateescape") for w in number], [chunks[c] for c in np.flatnonzero(odd)], key, np.bincount(same, times, len(key)).astype("<u4")

    def rows(self, block: int, m: Merger) -> Iterator[pa.RecordBatch]:
        """Rows of distinct pre-tokens (k: the number of a row's first), rows of frequencies, and one of the documents."""
        plain, odd, key, times = self.entries(m)
        for pieces, first in ((plain, 0), (odd, len(plain))):
            for a in range(0, len(pieces), 50_000):
                some = pieces[a : a + 50_000]
                sizes = np.fromiter(map(len, some), "<u4", len(some))
                yield self._row(block, first + a, pieces=_pack(np.array([len(some)], "<u4"), sizes, np.frombuffer(b"".join(some), np.uint8)), odd=pieces is odd)
        count = len(plain) + len(odd)
        ends = np.searchsorted(key, np.arange(count + 1) << 16)
        a = 0
        while a < count:  # a piece has fewer entries than a row takes
            b = int(np.searchsorted(ends, ends[a] + ENTRIES, side="right")) - 1
            x, y = ends[a], ends[b]
            yield self._row(block, a, data=_pack(np.array([b - a], "<u4"), np.diff(ends[a : b + 1]).astype("<u4"), times[x:y], (key[x:y] & 0xFFFF).astype("<u2")))
            a = b
        yield self._row(block, 0, ids=self.ids, sizes=self.sizes)

    @staticmethod
    def _row(block: int, k: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"block": block, "k": k, **columns}], schema=_LAID)


def _laid(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a task's documents (id, text), numbered by task and place: the rows are written, so each block has one number."""
        m, made, held = _merger(path), TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                held.add(id_, text)
                if held.bytes > BLOCK_BYTES or len(held.ids) >= BLOCK_DOCS:
                    yield from held.rows(made, m)
                    made, held = made + 1, Block()
        if held.ids:
            yield from held.rows(made, m)

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, odd, block, k): a row for each pre-token of rows of them (block, k, pieces, odd)."""
    for batch in batches:
        for block, k, packed, odd in zip(*(c.to_pylist() for c in batch.columns)):
            raw = _unpack(packed)
            n = int.from_bytes(raw[:4], "little")
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4))])
            for a in range(0, n, 10_000):
                b = min(n, a + 10_000)
                offsets = (ends[a : b + 1] - ends[a]).astype(np.int32)
                piece = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[4 + 4 * n + int(ends[a]) : 4 + 4 * n + int(ends[b])])])
                yield pa.RecordBatch.from_arrays([piece, pa.array(np.full(b - a, odd)), pa.array(np.full(b - a, block)), pa.array(np.arange(k + a, k + b, dtype=np.int32))], schema=_PIECES)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, counts): numbers of the block's pieces, each as its distance from the one before, and their token counts. Rows (piece, odd, block, k) come sorted, so each distinct piece is counted once."""
        m, last, held, size = _merger(path), (None, 0), [], 0

        def count(words: list[bytes], odd: bool) -> list[int]:
            if odd:
                return [len(e) for e in m.lib.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            return m.merge([w.decode("utf-8", "surrogateescape") for w in words])[1].tolist()

        def ready() -> pa.RecordBatch:
            block, k, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((k, block))
            block, k, n = block[order], k[order], n[order].astype("<u4")
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            packed = [_pack(np.diff(k[a:b], prepend=0).astype("<u4"), n[a:b]) for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(packed, pa.binary())], schema=_COUNTED)

        for batch in batches:
            for odd in (False, True):
                part = batch.filter(batch.column(1) if odd else pc.invert(batch.column(1)))
                if not part.num_rows:
                    continue
                coded = part.column(0).dictionary_encode()
                words = coded.dictionary.to_pylist()
                carried = [last[1]] if last[0] == (odd, words[0]) else []
                counts = carried + (count(words[len(carried) :], odd) if len(words) > len(carried) else [])
                last = (odd, words[-1]), counts[-1]
                held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), np.array(counts, np.int64)[coded.indices.to_numpy()]))
                size += part.num_rows
            if size > ENTRIES:
                yield ready()
                held, size = [], 0
        if held:
            yield ready()

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, n_tokens) of blocks, whose rows come together, counts before frequencies: the sum of counts times frequencies."""
    now, ids, sizes, n, total = None, [], [], np.zeros(0, np.int64), np.zeros(BLOCK_DOCS, np.int64)

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total[: len(ids)])], schema=_SUMS)

    for batch in batches:
        for row in range(batch.num_rows):
            block, k, data, its_ids, its_sizes, counts = (c[row] for c in batch.columns)
            if block.as_py() != now:
                if now is not None:
                    yield ready()
                now, ids, sizes, n, total = block.as_py(), [], [], np.zeros(0, np.int64), np.zeros(BLOCK_DOCS, np.int64)
            if counts.is_valid:
                steps, its_counts = np.frombuffer(_unpack(counts.as_py()), "<u4").reshape(2, -1)
                at = np.cumsum(steps, dtype=np.int64)
                if at[-1] >= len(n):
                    n = np.concatenate([n, np.zeros(int(at[-1]) + 1 + len(n) // 2, np.int64)])
                n[at] = its_counts
            elif data.is_valid:
                raw, a = _unpack(data.as_py()), k.as_py()
                p = int.from_bytes(raw[:4], "little")
                df = np.frombuffer(raw, "<u4", p, 4)
                entries = int(df.sum())
                times = np.frombuffer(raw, "<u4", entries, 4 + 4 * p)
                at = np.frombuffer(raw, "<u2", entries, 4 + 4 * p + 4 * entries)
                total += np.bincount(at, np.repeat(n[a : a + p], df) * times, len(total)).astype(np.int64)
            else:
                ids, sizes = its_ids.as_py(), its_sizes.as_py()
    if now is not None:
        yield ready()


def _encode(texts: Iterator[bytes], path: str) -> Iterator[list[bytes]]:
    known = _memory("ids", path, _merger(path).encode)
    for docs in _groups(texts):
        known.learn(set().union(*docs))
        yield [b"".join(map(known.__getitem__, words)) for words in docs]


def _decode(raw: bytes | None, path: str) -> str | None:
    if raw is None:
        return None
    lib, ids = _library(path), np.frombuffer(raw, "<u4").tolist()
    return lib.decode(ids, skip_special_tokens=False) if lib.decoder else " ".join(map(_merger(path).names.__getitem__, ids))


def bpe_encode(text: Column, path: str | None = None) -> Column:
    """The ids of each whole text as little-endian unsigned 32-bit integers (binary); a null text has none."""
    path = path or tokenizer_path()

    @F.arrow_udf("binary")
    def encode(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            for ids in _encode(_texts(col), path):
                yield pa.array(ids, pa.binary())

    return encode(text)


def bpe_decode(ids: Column, path: str | None = None) -> Column:
    """The text that the library's decode() gives for such ids with special tokens kept; null for null."""
    path = path or tokenizer_path()

    @F.arrow_udf("string")
    def decode(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            for a in range(0, len(col), 500):
                yield pa.array([_decode(x.as_py(), path) for x in col[a : a + 500]], pa.string())

    return decode(ids)


BOTH = "struct<ids:binary,decoded:string>"


def bpe_round_trip(text: Column, path: str | None = None) -> Column:
    """bpe_encode() and, of its ids, bpe_decode(), in one pass through a Python worker."""
    path = path or tokenizer_path()

    @F.arrow_udf(BOTH)
    def both(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            for ids in _encode(_texts(col), path):
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([_decode(x, path) for x in ids], pa.string())], names=["ids", "decoded"])

    return both(text)


def with_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row: how many ids the tokenizers library gives for each whole text.

    Pre-token frequencies are laid down per block of documents. The distinct pre-tokens of all blocks are dealt by
    pre-token, which puts equal ones beside each other, and each is counted once; a pre-token has one row a block, so none is hot. The counts
    go back to their blocks and are summed with the frequencies; no document's ids are made. Null and empty texts count 0.
    Repeated rows each have a result, a null id stays null, an empty table gives no rows; other columns are not read.
    """
    path = path or tokenizer_path()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    laid = save(d.mapInArrow(_laid(path), _LAID_SQL))
    pieces = laid.where("pieces is not null").select("block", "k", "pieces", "odd").mapInArrow(_pieces, "piece binary, odd boolean, block long, k int")
    dealt = pieces.repartition("piece", "odd").sortWithinPartitions("odd", "piece")
    counts = dealt.mapInArrow(_counted(path), "block long, counts binary")
    freqs = laid.where("pieces is null").select("block", "k", "data", "ids", "sizes")
    both = freqs.unionByName(counts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("counts").isNull())
    out = both.mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def with_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (binary) and decoded for each row; null and empty texts have no ids and decode to ''. Repeated rows each have a result, a null id stays null; other columns are not read."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), bpe_round_trip(F.col(text_col).cast("string"), path).alias("both"))
    return d.select("doc_id", "both.ids", "both.decoded")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(table(spark, sf_dir, "documents"))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_bpe(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
