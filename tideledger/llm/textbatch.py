"""Vectorised work on a batch of UTF-8 texts inside a Spark task.

A chunk is a run of rows whose texts lie end to end in one byte array. All
word classes used by the operators are ASCII classes (every byte of 0x80 and
above is a word byte), so words can be found bytewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
#: Bytes that are hashed together.
HASH_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Digits, lower-case letters and everything outside ASCII (for lower-cased text).
ALNUM_WORD = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but space and 0x09-0x0D.
BLANK_WORD = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes that begin a code point.
LEAD = ~byte_table((0x80, 0xBF))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the offsets of each; null counts as empty."""
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table`` bytes, and the runs' offsets by text."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    begins[first] = inside[first]
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for a stretch of HASH_BYTES, whatever the length of texts."""
    up, down = np.full(HASH_BYTES + 1, _BASE), np.full(HASH_BYTES + 1, _U(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = _U(1)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each span the sum of its bytes' values times powers of the base, from the first byte on; at most HASH_BYTES of data."""
    up, down = _powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (in ascending order), equal for equal bytes wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if len(data) <= HASH_BYTES:
        sums = _polynomials(data, starts, ends)
    else:
        sums, i = np.zeros(len(starts), np.uint64), 0
        while i < len(starts):
            at = int(starts[i])
            j = int(np.searchsorted(ends, at + HASH_BYTES, side="right"))
            if j > i:
                sums[i:j] = _polynomials(data[at : int(ends[j - 1])], starts[i:j] - at, ends[i:j] - at)
                i = j
                continue
            # a span longer than a stretch: its stretches' sums, each by the power that it stands at
            power, step = _U(1), _powers()[0][HASH_BYTES]
            with np.errstate(over="ignore"):
                for a in range(at, int(ends[i]), HASH_BYTES):
                    part = data[a : min(a + HASH_BYTES, int(ends[i]))]
                    sums[i] += _polynomials(part, np.array([0]), np.array([len(part)]))[0] * power
                    power = power * step
            i += 1
    return mix(sums + (ends - starts).astype(np.uint64) * _BASE)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of ``n`` consecutive word hashes, at each place where ``n`` follow."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    step = mix(np.array([seed * 2 + 0x51ED27], dtype=np.uint64))[0] | _U(1)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = out * step + words[j : len(words) - n + 1 + j]
    return mix(out + _U(n))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of integer ``values`` over each text's range of items."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_of(offsets: np.ndarray) -> np.ndarray:
    """The text's number of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, one entry more than bytes."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LEAD[data], out=out[1:])
    return out
