"""Numpy views of UTF-8 text columns for code that runs inside Spark tasks.

Texts stay in their Arrow buffers: no Python string is made. A block is some consecutive rows,
each followed by one newline byte, so that no word runs from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
STEP_BITS = 16
STEP = 1 << STEP_BITS


@dataclass
class Block:
    """`data[starts[i] : starts[i] + sizes[i]]` is the text of row i of `rows`."""

    rows: pa.RecordBatch
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def text_offsets(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data) if data is not None else memoryview(b""), at.astype(np.int64)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[Block]:
    """Cut batches into blocks of about `limit` text bytes; a longer text is a block of its own.

    Null texts count as empty.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if len(texts) == 0:
            continue
        if texts.null_count:
            texts = texts.fill_null("")
        data, at = text_offsets(texts)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            cuts = at[first : last + 1]
            joined = b"\n".join([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [b""])
            sizes = np.diff(cuts)
            starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
            yield Block(batch.slice(first, last - first), np.frombuffer(joined, np.uint8), starts, sizes)
            first = last


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Digits, lower-case letters and every byte beyond ASCII.
WORD_BYTES = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
WORD_BYTES_ANY_CASE = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SPACE_BYTES = byte_set((0x09, 0x0D), (0x20, 0x20))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table[data]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of `base`."""
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, base % 2**64, np.uint64))))


#: Powers up to STEP; a farther one is one of these times a power of base ** STEP. So the memory that
#: a worker keeps for them does not grow with the longest block it has seen.
_UP, _DOWN = _powers(int(BASE), STEP), _powers(int(INVERSE), STEP)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; equal spans have equal hashes wherever they stand."""
    up, down = (_powers(pow(int(b), STEP, 2**64), (len(values) >> STEP_BITS) + 1) for b in (BASE, INVERSE))
    sums = np.zeros(len(values) + 1, np.uint64)
    for k, a in enumerate(range(0, len(values), STEP)):
        part = values[a : a + STEP].astype(np.uint64) + np.uint64(1)
        part *= _UP[: len(part)]
        part *= up[k]
        part[:1] += sums[a : a + 1]
        np.cumsum(part, out=sums[a + 1 : a + 1 + len(part)])
    back = _DOWN[starts & (STEP - 1)] * down[starts >> STEP_BITS]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64) * BASE)


def owners(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row of each position."""
    return np.searchsorted(starts, positions, "right") - 1
