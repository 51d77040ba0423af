"""Shared pieces: tables, free column names and word hashing in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A boolean for each byte: inside one of the closed ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Words `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: the bytes between them.
SPACE = byte_table([(0x20, 0x20), (0x09, 0x0D)])
NONWORD = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: For bytes.translate: lower case, and every byte that is in no word to a space.
SPACE_MAP = bytes(0x20 if SPACE[i] else int(LOWER[i]) for i in range(256))
WORD_MAP = bytes(0x20 if NONWORD[int(LOWER[i])] else int(LOWER[i]) for i in range(256))


def utf8_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; a null has no bytes."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def pieces(offsets: np.ndarray, at_most: int = 600_000):
    """Ranges of rows with about at_most bytes; a longer row is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + at_most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def word_starts(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of rows begin, as word_hashes() takes them, and where each row's words begin among them (one more than rows)."""
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of rows, and where each row's words begin (one more than rows).

    offsets are relative to data; between says which bytes separate words.
    """
    rows, n = len(offsets) - 1, len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    low = LOWER[data]
    inside = ~between[low]
    left = np.empty(n, bool)
    left[0], left[1:] = True, ~inside[:-1]
    right = np.empty(n, bool)
    right[-1], right[:-1] = True, ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    left[edge] = True
    right[edge[edge > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & left), np.flatnonzero(inside & right) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[low] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))
    return hashes, np.searchsorted(starts, offsets)
