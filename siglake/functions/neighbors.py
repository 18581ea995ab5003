"""Kernels over the places about each place of a frame.

Nothing but numpy is imported here, so that a Python worker that runs these holds little more than its interpreter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Values that `stored` gives a kernel at once: 1 MB, and batches of some 10,000 rows.
BLOCK = 125_000


def mean_of(y: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Over the last axis, of values that are there."""
    return np.where(there, y, 0).sum(-1) / there.sum(-1)


def std_of(y: np.ndarray, there: np.ndarray) -> np.ndarray:
    d = np.where(there, y - mean_of(y, there)[..., None], 0)
    return np.sqrt((d * d).sum(-1) / there.sum(-1))


def median_of(y: np.ndarray, there: np.ndarray) -> np.ndarray:
    own, n = np.sort(np.where(there, y, np.nan), axis=-1), there.sum(-1, keepdims=True)  # NaN is the largest, and what isn't there behind it
    low, high = (np.take_along_axis(own, np.minimum(k, y.shape[-1] - 1), axis=-1)[..., 0] for k in (np.maximum(n - 1, 0) // 2, n // 2))
    return (low + high) / 2


def stored(batches: Iterator, width: int, offsets: list[tuple[int, int]], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str]) -> Iterator:
    """Flat Arrow batches (keys, ap, ml, kernel's value) of batches (keys, values), whose value k is at place divmod(k, width).

    Buffers go to numpy and back as they are: pa.array, pa.scalar and to_numpy import pandas, 25 MB in each worker.
    """
    import pyarrow as pa

    def arrow(v: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
        bits = None if there is None else pa.py_buffer(np.packbits(there, bitorder="little"))
        return pa.Array.from_buffers(pa.from_numpy_dtype(v.dtype), len(v), [bits, pa.py_buffer(v)])

    def valid(a: pa.Array) -> np.ndarray:
        if not a.null_count:
            return np.ones(len(a), dtype=bool)
        return np.unpackbits(np.frombuffer(a.buffers()[0], np.uint8), bitorder="little")[a.offset : a.offset + len(a)].astype(bool)

    def numbers(a: pa.Array, kind: type) -> np.ndarray:
        return np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a)] if len(a) else np.empty(0, kind)

    tables = {}

    def places(n: int) -> np.ndarray:
        if n not in tables:
            at = {divmod(k, width): k for k in range(n)}
            tables[n] = np.array([[at.get((a + da, m + dm), n) for da, dm in offsets] for a, m in at])
        return tables[n]

    for b in batches:
        if not b.num_rows:  # may have no buffers
            continue
        values = b.column(b.num_columns - 1)
        flat, ends = values.values, numbers(values.offsets, np.int32)
        starts, lengths = ends[:-1], np.where(valid(values), np.diff(ends), 0)
        for n in np.unique(lengths[lengths > 0]).tolist():
            table, of = places(n), np.flatnonzero(lengths == n)
            ap, ml = (v.astype(np.int32) for v in np.divmod(np.arange(n), width))
            many = max(1, BLOCK // table.size)
            for f in (of[k : k + many] for k in range(0, len(of), many)):
                own = flat.take(arrow((starts[f][:, None] + np.arange(n)).ravel())).cast(pa.float64(), safe=False)
                there = valid(own).reshape(-1, n)
                x = np.where(there, numbers(own, np.float64).reshape(-1, n), np.nan)
                h = np.pad(there, ((0, 0), (0, 1)))[:, table]
                with np.errstate(invalid="ignore", divide="ignore"):
                    v = kernel(np.pad(x, ((0, 0), (0, 1)), constant_values=np.nan)[:, table], h)
                heads = [c.take(arrow(np.repeat(f, n))) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*heads, arrow(np.tile(ap, len(f))), arrow(np.tile(ml, len(f))), arrow(v.ravel(), h.any(-1).ravel())], names)
