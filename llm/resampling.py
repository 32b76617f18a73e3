"""Importance resampling towards a target: hashed n-gram counts of both tables give every bucket a gain, a document's
weight is the sum of the gains of its features, and seeded Gumbel noise on the weights draws without replacement.

Features are never built as strings. A word's CRC is computed once; the CRC of "a b" follows from those of "a" and " b"
by the matrix over GF(2) that appends zero bytes, one matrix for each length, so an n-gram costs one look-up a byte of CRC.
Both tables are scanned whole, twice for the documents (counts, then weights); a task gives at most one row for each
bucket. The draw ranks by a range partitioning, so no task and no driver sees more than its share of the documents.

Defined results: a null or empty text, or one without words, has no features and weight 0 but still a score; very long
texts are scanned whole, slice by slice; features that repeat count each time; ties of scores go to the smaller id, and
rows that repeat an id, or have none (taken as the empty text, last in ties), are documents of their own, in any order
among equals; an empty table gives an empty table, an empty target gives every bucket t = 0; columns other than doc_id
and text (of any name) play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from llm.kernel import Words, ints, release, slices
from llm.shared import materialize

BUCKETS, LONGEST_RUN, SEED = 10000, 3, 42
MIN_WORDS, SHARE = 20, (5, 100)
#: Lower-cased letters, digits and bytes of other scripts are parts of words; all else counts as a space.
WORD_BYTES = np.full(256, 32, np.uint8)
WORD_BYTES[128:] = np.arange(128, 256)
WORD_BYTES[48:58], WORD_BYTES[97:123], WORD_BYTES[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
#: Lengths with a table of their own; longer ones go by their binary digits. Words beyond BY_BYTE bytes are left to zlib.
DIRECT, BY_BYTE = 64, 48


def _times(matrix: list[int], x: int) -> int:
    out = 0
    for bit in range(32):
        if x >> bit & 1:
            out ^= matrix[bit]
    return out


def _tables(matrix: list[int]) -> np.ndarray:
    """The matrix (images of the 32 bits) as four look-up tables, one for each byte of the argument."""
    return np.array([[_times(matrix, b << 8 * k) for b in range(256)] for k in range(4)], np.uint32)


class Shifts:
    """What appending n zero bytes does to a CRC: the n-th power of one matrix over GF(2)."""

    def __init__(self):
        # appending a byte to a message without the register's start and end values: read off zlib itself
        blank = lambda x: zlib.crc32(b"\0", x ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        one = [blank(1 << b) for b in range(32)]
        self.doubling, power = [], one
        for _ in range(40):  # 2**k zero bytes each
            self.doubling.append(_tables(power))
            power = [_times(power, c) for c in power]
        step, at = [1 << b for b in range(32)], []
        for _ in range(DIRECT + 1):
            at.append(_tables(step))
            step = [_times(one, c) for c in step]
        self.direct = np.stack(at).reshape(-1)
        self.bytes = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
        self.step = self.doubling[0][0]  # the table of a plain CRC: one byte onwards

    @staticmethod
    def _apply(tables: np.ndarray, base, crc: np.ndarray) -> np.ndarray:
        out = tables[base + (crc & 255)]
        for k in (1, 2, 3):
            out = out ^ tables[base + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
        return out

    def after(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The CRCs shifted by n bytes each."""
        far = np.flatnonzero(n > DIRECT)
        out = self._apply(self.direct, np.minimum(n, DIRECT) * 1024, crc)
        if len(far):
            some, left = crc[far], n[far].copy()
            for tables in self.doubling:
                if not left.any():
                    break
                odd = np.flatnonzero(left & 1)
                some[odd] = self._apply(tables.reshape(-1), 0, some[odd])
                left >>= 1
            out[far] = some
        return out

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The CRC of each word, all words in step byte by byte; long words one by one."""
        size = end - start
        out = np.empty(len(start), np.uint32)
        order = np.argsort(-np.minimum(size, BY_BYTE + 1), kind="stable")
        long = int(np.count_nonzero(size > BY_BYTE))
        for i in order[:long]:
            out[i] = zlib.crc32(data[start[i] : end[i]])
        order = order[long:]
        if len(order):
            s, n = start[order], size[order]
            crc, alive = np.full(len(order), 0xFFFFFFFF, np.uint32), len(order)
            for j in range(int(n[0])):
                alive = int(np.searchsorted(-n, -j, "left"))  # words of more than j bytes: a head of the order
                head = crc[:alive]
                crc[:alive] = self.step[(head ^ data[s[:alive] + j]) & 255] ^ (head >> np.uint32(8))
            out[order] = crc ^ np.uint32(0xFFFFFFFF)
        return out


_shifts: list[Shifts] = []


def shifts() -> Shifts:
    if not _shifts:
        _shifts.append(Shifts())
    return _shifts[0]


def _words(part: pa.RecordBatch) -> Words:
    """Words of the slice's texts under WORD_BYTES."""
    column = part["text"]
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    kind = pa.large_string() if wide is np.int64 else pa.string()
    return Words(pa.Array.from_buffers(kind, n, [None, pa.py_buffer((bounds - bounds[0]).astype(wide)), pa.py_buffer(WORD_BYTES[raw])]))


def features(part: pa.RecordBatch, longest: int, buckets: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of a slice and, for each run length, the row and the bucket of every run."""
    w, by = _words(part), shifts()
    row = w.row
    size = (w.end - w.start).astype(np.int64)
    crc = by.words(w.data, w.start, w.end)
    led = by.after(np.full(len(crc), by.bytes[32], np.uint32), size) ^ crc  # a space and the word
    found, run = [], crc
    for k in range(longest):
        if k:
            run = by.after(run[:-1], size[k:] + 1) ^ led[k:] if len(run) else run
        n = len(run)
        inside = row[:n] == row[k : k + n]  # runs across two documents are left out, but go on as heads of nothing
        found.append((row[:n][inside], (run[inside] % np.uint32(buckets)).astype(np.int64)))
    return w, found


def bucket_counts(texts: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for _, hit in features(part, longest, buckets)[1]:
                total += np.bincount(hit, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])
        release()

    plain = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) for each bucket; `buckets` rows of each table reach the driver."""
    count = []
    for texts in (docs, target):
        have = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, longest, buckets).collect():
            have[r["bucket"]] = r["n"]
        count.append(have.tolist())
    s, t = count
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(all_s) / (float(a + 1) * float(all_t)))) for a, b in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w, found = features(part, longest, buckets)
            number, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for row, hit in found:
                number += np.bincount(row, minlength=part.num_rows)
                total = np.r_[0, np.cumsum(shared.value[hit])]
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                weight += total[cuts[1:]] - total[cuts[:-1]]
            yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(np.diff(w.first), pa.int64()), pa.array(number), pa.array(weight)], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int):
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256 of "<seed>:<doc_id>"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def draw(scored: DataFrame, share: tuple[int, int], min_words: int) -> DataFrame:
    """`scored` with rank: the floor(share of the documents with `min_words` words) highest scores get 1, 2, 3 ... Rows are
    cut into ranges of the order; the counts of the ranges (one number each) tell where each begins."""
    order = [F.col("can").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("salt")]
    able = scored.withColumn("can", F.col("n_words") >= min_words).withColumn("salt", F.monotonically_increasing_id())
    ranged = materialize(able.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "resample-ranges")
    sizes = sorted((r["range"], r["n"], r["able"]) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("can").cast("long")).alias("able")).collect())
    k = share[0] * sum(r[2] for r in sizes) // share[1]
    begin, at = {}, 0
    for number, n, _ in sizes:
        if at < k:
            begin[number] = at
        at += n
    if not k:
        return ranged.withColumn("rank", F.lit(None).cast("long"))
    last = max(begin)  # ranges beyond it hold no drawn row and are left unsorted
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in begin.items() for x in pair]), F.col("range"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + offset.cast("long")
    drawn = ranged.where(F.col("range") <= last).withColumn("rank", F.when(place <= k, place).cast("long"))
    return drawn.unionByName(ranged.where(F.col("range") > last).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn), n_words of every document."""
    gain = gains(docs, target, longest, buckets)
    scored = materialize(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed)), "resample-scores")
    return draw(scored, share, min_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
