"""Hashed n-gram indicators of texts: lower-case words, as they stand and without marks at their ends, pairs of
words, and runs of up to three word shapes; on demand also the first bytes of words (`word_starts`).

A shape is the case, the last character's class, a size class and whether the word repeats the one before it.

A fit's sample is bounded by rows (its caller's parameter) and by SAMPLE_BYTES of text: rows go in the order of their
ids' hashes while the running size stays within it. Scoring goes through whole texts, SCORE_SLICE bytes or one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from llm.kernel import LOWER, U, Words, mix, slices, sort_unique
from llm.shared import fold, materialize

BITS, SCORED = 20, "__scored_text__"
SAMPLE_BYTES, SCORE_SLICE = 64 << 20, 1 << 20
STARTS = (4, 5, 6, 7, 8)
#: Classes of bytes: letters, digits, marks that end sentences or clauses, other marks, bytes beyond ASCII.
KIND = np.full(256, 5, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 3, 4
for _i, _mark in enumerate(b".,!|:;?"):
    KIND[_mark] = 6 + _i


def _bare(w: Words, kind: np.ndarray) -> None:
    """Take up to three marks off either end of each word."""
    for _ in range(3):
        w.end = w.end - ((kind[w.end - 1] >= 5) & (w.end - w.start > 1))
        w.start = w.start + ((kind[w.start] >= 5) & (w.end - w.start > 1))


def indicators(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of each row, ascending: (numbers, first index of each row and the end)."""
    w = Words(column)
    raw, row, n = w.data, w.row, len(w.start)
    w.data = LOWER[raw]
    h = w.hashes()
    if not n:
        return np.zeros(0, np.int32), np.zeros(w.rows + 1, np.int64)
    kind = KIND[raw]
    start, end = w.start, w.end
    _bare(w, kind)
    bare = w.hashes()
    w.start, w.end = start, end
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    caps = np.minimum(upper[w.end] - upper[w.start], 2)
    again = np.zeros(n, bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = (kind[w.start].astype(U) << U(12)) | (kind[w.end - 1].astype(U) << U(8)) | (caps.astype(U) << U(4)) | (np.minimum(w.end - w.start, 15) >> 2).astype(U) << U(1) | again.astype(U)
    shape = mix(shape + U(1 << 40))
    found, rows = [mix(h), mix(bare + U(9)), mix(shape)], [row, row, row]
    for base, size, salt in ((h, 2, 3), (shape, 2, 5), (shape, 3, 7)):
        if n >= size:
            inside = row[size - 1 :] == row[: n - size + 1]
            total = np.zeros(n - size + 1, U)
            for j in range(size):
                total += base[j : n - size + 1 + j] * U(2 * (salt + j) * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)
            found.append(mix(total[inside]))
            rows.append(row[: n - size + 1][inside])
    rows, found = np.concatenate(rows), (np.concatenate(found) >> U(64 - bits)).astype(np.int32)
    order = np.argsort(rows, kind="stable")
    return sort_unique(rows[order], found[order], w.rows)


def word_starts(column: pa.Array, bits: int = BITS, sizes: tuple[int, ...] = STARTS) -> tuple[np.ndarray, np.ndarray]:
    """As `indicators`, with the first 4 to 8 bytes of each longer word, in lower case and without marks."""
    x, first = indicators(column, bits)
    w = Words(pc.utf8_lower(column))
    rows, found, row = [np.repeat(np.arange(w.rows), np.diff(first))], [x], w.row
    if len(w.start):
        _bare(w, KIND[w.data])
        start, end = w.start, w.end
        for size in sizes:
            long = end - start > size
            w.start, w.end = start[long], start[long] + size
            rows.append(row[long])
            found.append((mix(w.hashes() + U(1000 + size)) >> U(64 - bits)).astype(np.int32))
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return sort_unique(rows[order], np.concatenate(found)[order], w.rows)


def collect_indicators(docs: DataFrame, features=indicators) -> tuple[list, list[np.ndarray]]:
    """(ids, features) of a sample whose size the caller bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x, first = features(part["text"])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(first.astype(np.int32), x)], names=["doc_id", "x"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<int>").toArrow()
    return rows["doc_id"].to_pylist(), [np.asarray(x.values) for x in rows["x"]]


def sample_texts(docs: DataFrame, ids: DataFrame, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row for each of the (bounded) ids that `docs` has, of rows that repeat an id the least text; `most_bytes` of
    text at most, or one text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(plain.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "sample")
    # a few thousand rows: those of the bounded sample
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = found.select("doc_id", F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(order).alias("running"), F.row_number().over(order).alias("nth"))
    return found.join(F.broadcast(sizes.where((F.col("running") <= most_bytes) | (F.col("nth") == 1)).select("doc_id")), "doc_id", "left_semi")


def known_labels(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, y of the rows that may be learned from: fold other than 0; conflicting labels of an id count as 1."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & (fold() != 0))
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(name).cast("int")).alias("y"))


def least_hashed(ids: DataFrame, n: int) -> DataFrame:
    """A fixed sample of at most n rows: those whose ids hash lowest."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def score_texts(docs: DataFrame, score, threshold: float, features=indicators) -> DataFrame:
    """`docs` (all its columns but any named like these) with `score` and `predicted` after them; score(numbers, first)
    gives a value for each row."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    # the text goes over once; only a column that isn't a string has to go along a second time, as one
    text = next(f.name for f in docs.schema if f.name.lower() == "text")
    own = isinstance(docs.schema[text].dataType, StringType)
    sent, scored = (docs, text) if own else (docs.withColumn(SCORED, F.col("text").cast("string")), SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, scored, SCORE_SLICE):
            s = score(*features(part[scored])).astype(np.float64)
            keep = [c for c in part.schema.names if c != SCORED]
            yield pa.RecordBatch.from_arrays([part[c] for c in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return sent.mapInArrow(run, schema)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty ones included."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
