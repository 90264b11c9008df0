"""Worker code of the whitening: one pass over batches of vectors, in numpy. Its functions reach the executors by value (see whitening.py)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Numbers of a batch that are worked on at a time.
NUMBERS = 1 << 20


def integers(column) -> np.ndarray:
    """Rows of x = floor(64 * c) + 1000000, in pieces."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            c = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            m = c.reshape(len(chunk), -1)
            step = max(1, NUMBERS // m.shape[1])
            for a in range(0, len(m), step):
                yield np.floor(64.0 * m[a : a + step]).astype(np.int64) + 1_000_000


def center(n: int, sums: list[int]):
    """x -> x - sums / n, both parts of the mean taken off by themselves, so that the error is that of the difference."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - rest


def task_totals(batches):
    """For each dimension: rows, and the sums of the high and low halves of x."""
    n, high, low = 0, 0, 0
    for b in batches:
        for x in integers(b.column("embedding")):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        lines = np.arange(len(high), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(np.full(len(lines), n)), pa.array(high), pa.array(low)], names=["line", "n", "high", "low"])


def joined(rows) -> tuple[int, list[int]] | None:
    by = sorted(rows, key=lambda r: r.line)
    return (by[0].n, [(r.high << 32) + r.low for r in by]) if by else None


def task_sums(product):
    """A task's sum of product(x) over its rows, one output row for each of its lines."""
    def run(batches):
        total = None
        for b in batches:
            for x in integers(b.column("embedding")):
                y = product(x)
                total = y if total is None else total + y
        if total is not None:
            lines, task = np.arange(len(total), dtype=np.int32), np.full(len(total), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(task), pa.array([np.ascontiguousarray(r).tobytes() for r in total], pa.binary())], names=["line", "task", "sums"])

    return run


def add_up(rows: pa.Table) -> pa.Table:
    """One row for a line: its sums in the order of tasks."""
    rows = rows.sort_by([("task", "ascending"), ("sums", "ascending")])
    total = 0.0
    for s in rows["sums"].to_pylist():
        total = total + np.frombuffer(s)
    return pa.table({"line": rows["line"][:1], "task": rows["task"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def squares(centred):
    return lambda x: (centred(x) ** 2).sum(axis=0)[None, :]


def covariance_times(centred, basis):
    """The sum of y (y . basis) over centred rows y."""
    def product(x):
        y = centred(x)
        return y.T @ (y @ basis)

    return product


def moments(centred, axes):
    """Second moments of the whitened rows, and in one more line their sums."""
    def product(x):
        w = centred(x) @ axes
        return np.vstack([w.T @ w, w.sum(axis=0)])

    return product


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n x - S) ** 2 over dimensions, exact; None beyond a long."""
    far = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)))
    if far * far * x.shape[1] < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        t = n * x - np.array(sums, np.int64)
        return (t * t).sum(axis=1).tolist()
    every = (sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in every]


def whitener(n: int, sums: list[int], axes: np.ndarray):
    centred = center(n, sums)

    def run(batches):
        for b in batches:
            at = 0
            for x in integers(b.column("embedding")):
                w = centred(x) @ axes
                values = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(at, len(x)), pa.array(deviations(x, n, sums), pa.int64()), values], names=["vec_id", "deviation", "whitened"])
                at += len(x)

    return run
