"""Vectorised scanning of Arrow text columns: word bounds, word hashes and hashes of word spans.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Work goes through slices of about a MB, so
memory follows the slice (or the longest single text), not the Arrow batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = np.asarray(x, U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(256))
LENGTH = U(0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.r_[U(1), np.full(n - 1, U(b))]) for b in (self.base, self.inverse))
        return self.up, self.down


BYTES, SPANS, OTHER = Powers(0x9DDFEA08EB382D69), Powers(0xC2B2AE3D27D4EB4F), Powers(0xA0761D6478BD642F)
SEGMENT = 1 << 20


class Words:
    """Words of a column: byte bounds `start` and `end`, and `first`, the index of each row's first word."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "")
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        n = len(column)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        self.data, self.bounds = LOWER[data] if lower else data, bounds
        inside = ~SPACE[data]
        begin, stop = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
            begin[edges] = inside[edges]
            stop[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.first[-1] = len(self.start)
        self.rows = n

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        out, i, n = np.empty(len(self.start), U), 0, len(self.start)
        while i < n:
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.start, base + SEGMENT)))
            size = int(self.end[j - 1] - base)
            up, down = BYTES.of(size + 1)
            total = np.zeros(size + 1, U)
            np.cumsum(BYTE[self.data[base : base + size]] * up[:size], out=total[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * LENGTH)
            i = j
        return out


class Spans:
    """Hashes of any span of consecutive items from their hashes, in constant time each."""

    def __init__(self, hashes: np.ndarray, powers: Powers = SPANS):
        n = len(hashes)
        up, self.down = powers.of(n + 1)
        self.total = np.zeros(n + 1, U)
        np.cumsum(hashes * up[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U) * LENGTH)


#: What a worker keeps from task to task of a step. Workers live on, so tasks of other steps drop it.
KEPT: dict = {}


def drop_kept() -> None:
    if KEPT:
        KEPT.clear()
        gc.collect()
        release()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most `limit` bytes together; a longer text comes alone. What earlier tasks kept goes
    first, unless this step is the one to `keep` it."""
    if not keep:
        drop_kept()
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
            yield batch.slice(i, j - i)
            i = j
    release()


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ints(array: pa.Array, fill: int = 0) -> np.ndarray:
    return pc.fill_null(array, fill).to_numpy(zero_copy_only=False)


def sort_unique(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, rows ascending: (values, first index of each row and the end)."""
    cuts = np.searchsorted(rows, np.arange(n_rows + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sort order by the keys, first key first, and where in it each run of equal keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def task() -> int:
    """A number that no other task of the stage has, with room for 2**20 flushes."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 20
