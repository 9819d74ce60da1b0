"""Whole texts as flat Arrow and numpy arrays: splitting and counting without a Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once in a Python worker; a single longer text is taken whole.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Give freed memory back to the system: workers live on, and their heaps count against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw and len(texts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about limit bytes."""
    _, offsets = flat(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield texts.slice(start, stop - start)
        start = stop


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Contiguous pieces of UTF-8 bytes as an Arrow string array, without a copy of the bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, and each text's n + 1 bounds among them."""
    n = len(data)
    if not n:
        return strings(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    opens = ~space
    opens[1:] &= space[:-1] | first[1:n]
    starts = np.flatnonzero(opens)
    before = np.cumsum(~space, dtype=np.int32 if n < 1 << 31 else np.int64)
    bounds = np.append(before[starts] - 1, before[-1]).astype(np.int64)
    return strings(data[~space], bounds), np.searchsorted(starts, offsets)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[s : s + l] for all pairs."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Spans of fixed-width values as binary items, so that Arrow can gather them."""
    width = values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64) * width), pa.py_buffer(np.ascontiguousarray(values))])


def gathered(items: pa.Array, codes: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of the coded items on end, and the n + 1 bounds."""
    got = items.take(pa.array(codes))
    bounds = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1]
    raw = got.buffers()[2]
    values = np.frombuffer(raw, dtype, int(bounds[-1]) // np.dtype(dtype).itemsize) if raw and len(got) else np.zeros(0, dtype)
    return values, bounds // np.dtype(dtype).itemsize


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds, zero for empty spans; works on the first axis."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out
