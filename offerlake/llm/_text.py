"""Helpers shared by the text operators: Arrow columns in, numpy over UTF-8 bytes.

Texts are never turned into Python strings unless an operator needs them: the
Arrow buffers of a batch are read in place and cut into slices of a few MB at
row ends, so the temporary arrays stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20

# ASCII upper case to lower case, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z).
# Every byte of a multi-byte character is a word byte.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

# Bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE_BYTE = np.ones(256, dtype=bool)
NON_SPACE_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def add_columns(df: DataFrame, compute: Callable[[pa.RecordBatch], list[pa.Array]], fields: T.StructType,
                keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns (or those in ``keep``) and the computed ones.

    ``compute`` gets a record batch and returns one array per field.  A field
    takes the place of an input column of the same name (any case).
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=names)

    return df.mapInArrow(run, schema)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column and the start and end of each row; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0 or col.null_count == n:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=n + 1, offset=col.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    starts, ends = off[:-1], off[1:]
    if col.null_count:
        valid = col.is_valid().to_numpy(zero_copy_only=False)
        ends = np.where(valid, ends, starts)
    return data, starts, ends


def slices(starts: np.ndarray, ends: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about ``size`` bytes (one row at least)."""
    total = np.concatenate(([0], np.cumsum(ends - starts)))
    n, lo = len(starts), 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(total, total[lo] + size, "right")) - 1))
        yield lo, hi
        lo = hi


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes in one array, each row followed by the byte ``gap``; where each row starts in it."""
    lens = ends - starts
    begin = np.concatenate(([0], np.cumsum(lens + 1)))
    out = np.full(int(begin[-1]), gap, dtype=np.uint8)
    if np.array_equal(starts[1:], ends[:-1]):
        keep = np.ones(len(out), dtype=bool)
        keep[begin[1:] - 1] = False
        out[keep] = data[starts[0]:ends[-1]] if len(starts) else data[:0]
    else:
        for b, s, e in zip(begin.tolist(), starts.tolist(), ends.tolist()):
            out[b:b + e - s] = data[s:e]
    return out, begin[:-1]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of true values."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd multiplier modulo 2^64 and their inverses."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        inverse = pow(int(_MULT), -1, 1 << 64)
        with np.errstate(over="ignore"):
            up = np.full(size, _MULT, np.uint64)
            down = np.full(size, np.uint64(inverse), np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        if size <= 1 << 22:
            for old in [k for k in _powers if k < size]:
                del _powers[old]
            _powers[size] = up, down
        else:
            return up, down
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[s:e]`` for each span, by one prefix sum over all values.

    Equal spans get equal hashes wherever they stand.  Different spans may
    collide, so whatever must be exact compares the spans afterwards.
    """
    n = len(values)
    if n == 0:
        return np.zeros(len(starts), np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def window_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` consecutive word hashes from each place."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(word, at, at + width)


def words_of(buf: np.ndarray, table: np.ndarray, begin: np.ndarray):
    """Starts, ends and row numbers of the words of ``joined`` bytes."""
    s, e = runs(table[buf])
    return s, e, np.searchsorted(begin, s, "right") - 1
