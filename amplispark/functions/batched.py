"""Functions of rows in Arrow batches: each distinct row of a batch is computed once, sequences are compared as arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

#: Codes of letters: bases as they pair (a base and its partner add up to 3), 4 for N and 5 for any other letter.
CODE = np.full(256, 5, np.uint8)
for _k, _c in enumerate("ACGTN"):
    CODE[ord(_c)] = _k


def distinct_rows(columns: Iterable[pa.Array]) -> tuple[list[tuple], pa.Array]:
    """The distinct rows, and which of them each row is."""
    code, columns = None, [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    for c in columns:
        d = c.dictionary_encode()
        k = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(k if code is None else code * (len(d.dictionary) + 1) + k, return_inverse=True)[1]
    _, first, of = np.unique(code, return_index=True, return_inverse=True)
    take = pa.array(first)
    return list(zip(*[c.take(take).to_pylist() for c in columns], strict=True)), pa.array(of)


def by_distinct(f: Callable[..., tuple], fields: list[pa.Field], *columns: pa.Array) -> pa.Array:
    """struct of fields, of f of each distinct row."""
    rows, of = distinct_rows(columns)
    values = list(zip(*[f(*r) for r in rows], strict=True)) or [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(v, t.type).take(of) for v, t in zip(values, fields, strict=True)], fields=fields)


def laid_end_to_end(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all letters, each sequence's begin, its length); null is as empty."""
    seqs = seqs.combine_chunks() if isinstance(seqs, pa.ChunkedArray) else seqs
    raw = seqs.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    codes = CODE[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None and len(raw) else np.zeros(0, np.uint8)
    return codes, (ends[:-1] - ends[0]) if len(raw) else np.zeros(0, np.int64), np.diff(ends)


def sums(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of values over each span."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[begin + size] - total[begin]
