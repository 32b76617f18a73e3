"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: of the 18 runs of 18 words in a window of 35 words the one with the least hash (the last
of equals). Equal windows choose equal anchors, so documents that share a window meet at its anchor. An occurrence is
extended both ways over all windows that chose it; occurrences with equal anchor and equal extent form a class.
A class of two or more is repeated as a whole. Where an anchor has several classes, their windows are hashed one by
one (128 bits) and counted. What is repeated is then maximal: the union of windows that start more than once.

Only classes and windows move between tasks, folded for each flush of a map task, so a passage in every document
reaches its owner once for each flush. Documents and verdicts meet by a key of id and text.

Defined results: a null text has no words; rows that repeat a doc_id are documents of their own; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.kernel import OTHER, SPANS, Spans, U, Words, groups, mix, slices, task
from llm.shared import bounded, materialize, power_of_two

WINDOW, FLUSH = 35, 1 << 20
BUCKET_BYTES = 16 << 20


def windows(w: Words, size: int) -> np.ndarray:
    """Indices of words at which a window of `size` words starts within its row."""
    start = np.arange(len(w.start))
    return start[start + size <= np.repeat(w.first[1:], np.diff(w.first))]


def anchors(w: Words, spans: Spans, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, gram hash), in order: each window of a row falls to one anchor."""
    gram = (size + 1) // 2
    n = len(w.start) - gram + 1
    starts = windows(w, size)
    if n <= 0 or not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    at = np.arange(n)
    g = spans.of(at, at + gram)
    reach = size - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(g, reach)[:, ::-1]
    chosen = starts + (reach - 1) - view.argmin(1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(starts)) - 1
    return chosen[lo], starts[lo], starts[hi], g[chosen[lo]]


def _blobs(fid: int, bits: int, key: np.ndarray, second: np.ndarray, dk: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Fold equal (key, second) of one flush; a row for each bucket of keys, with the occurrences behind each entry."""
    order, begin = groups(key, second)
    k, s = key[order[begin]], second[order[begin]]
    count = np.diff(np.append(begin, len(order)))
    bucket = (k >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
    rows, first = np.unique(bucket, return_index=True)
    last = np.append(first[1:], len(bucket))
    ends = np.append(begin, len(order))
    cols: list[list] = [[] for _ in range(8)]
    for b, i, j in zip(rows.tolist(), first.tolist(), last.tolist()):
        o = order[ends[i] : ends[j]]
        gap = np.diff(k[i:j], prepend=U(0))
        for c, v in zip(cols, (fid, b, gap.tobytes(), s[i:j].tobytes(), count[i:j].astype(np.int32).tobytes(), dk[o].tobytes(), lo[o].astype(np.int32).tobytes(), hi[o].astype(np.int32).tobytes())):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())] + [pa.array(c, pa.binary()) for c in cols[2:]], names=LOG)


LOG = ["fid", "bucket", "gaps", "second", "counts", "dk", "lo", "hi"]
LOG_KINDS = "fid long, bucket long, gaps binary, second binary, counts binary, dk binary, lo binary, hi binary"


def _flushed(bits: int, pieces: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    fid, held, n = task(), [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= FLUSH:
            yield _blobs(fid, bits, *map(np.concatenate, zip(*held)))
            fid, held, n = fid + 1, [], 0
    if n:
        yield _blobs(fid, bits, *map(np.concatenate, zip(*held)))


def _seeds(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for part in slices(batches):
                w = Words(part["text"])
                spans = Spans(w.hashes())
                p, lo, hi, g = anchors(w, spans, size)
                if not len(p):
                    continue
                extent = spans.of(lo, hi + size) ^ mix((p - lo).astype(U) << U(32) | (hi - p + size).astype(U))
                row = w.row[lo]
                base = w.first[:-1][row]
                yield mix(g), extent, part["dk"].to_numpy()[row], lo - base, hi - base

        yield from _flushed(bits, pieces())

    return run


def _owner(size: int | None):
    """All entries of a bucket: 1 for those that occur twice or more; 2 added where a key has several classes."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(np.frombuffer(b, U)) for b in table["gaps"].to_pylist()]
        key = np.concatenate(keys).astype(U)
        second = np.frombuffer(b"".join(table["second"].to_pylist()), U)
        count = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32).astype(np.int64)
        order, begin = groups(key, second)
        each = np.diff(np.append(begin, len(order)))
        verdict = np.repeat((np.add.reduceat(count[order], begin) > 1).astype(np.uint8), each)
        if size:
            k = key[order[begin]]
            several = np.zeros(len(k), bool)
            same = k[1:] == k[:-1]
            several[1:] |= same
            several[:-1] |= same
            verdict |= np.repeat(several.astype(np.uint8) << 1, each)
        out = np.empty(len(key), np.uint8)
        out[order] = verdict
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"fid": table["fid"], "bucket": table["bucket"], "verdict": pa.array([v.tobytes() for v in np.split(out, cuts)], pa.binary())})

    return run


def _answers(folded: bool):
    """Occurrences behind entries with a verdict: whole extents, and extents whose windows are still to be counted.

    Of a repeated class one occurrence for each flush stands in for the others when its windows are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, dk, lo, hi, v in zip(*(batch[c].to_pylist() for c in ("counts", "dk", "lo", "hi", "verdict"))):
                count, v = np.frombuffer(counts, np.int32), np.frombuffer(v, np.uint8)
                if not v.any():
                    continue
                each = np.repeat(v, count)
                dk, lo, hi = np.frombuffer(dk, np.int64), np.frombuffer(lo, np.int32), np.frombuffer(hi, np.int32)
                head = np.zeros(len(each), bool)
                head[np.cumsum(count) - count] = True
                for kind, take in ((1, (each & 1) > 0), (2, ((each & 2) > 0) & (head | ((each & 1) == 0)))) if folded else ((1, each > 0),):
                    if take.any():
                        yield pa.RecordBatch.from_arrays([pa.array(dk[take]), pa.array(np.full(take.sum(), kind, np.int32)), pa.array(lo[take]), pa.array(hi[take])], names=["dk", "kind", "lo", "hi"])

    return run


def _count_windows(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for part in slices(batches):
                w = Words(part["text"])
                h = w.hashes()
                at, rows = [], []
                for r, packed in enumerate(part["open"].to_pylist()):
                    for lo, hi in zip(*unpack(packed)):
                        at.append(np.arange(lo, hi + 1) + w.first[r])
                        rows.append(np.full(hi - lo + 1, r))
                if not at:
                    continue
                at, rows = np.concatenate(at), np.concatenate(rows)
                one, two = Spans(h, SPANS).of(at, at + size), Spans(mix(h ^ U(77)), OTHER).of(at, at + size)
                pos = at - w.first[:-1][rows]
                yield mix(one), two, part["dk"].to_numpy()[rows], pos, pos

        yield from _flushed(bits, pieces())

    return run


def unpack(extents: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows of extents, which travel as one long each."""
    x = np.array(extents, np.int64)
    return x >> 32, x & 0xFFFFFFFF


def _cut(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n_words, n_removed, digests, texts = [], [], [], []
            for text, spans in zip(part["text"].to_pylist(), part["spans"].to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if spans:
                    gone = np.zeros(len(words) + 1, np.int32)
                    lo, hi = unpack(spans)
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, hi + size, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            arrays = [part["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def _decided(log: DataFrame, size: int | None) -> DataFrame:
    owned = log.select("fid", "bucket", "gaps", "second", "counts").groupBy("bucket").applyInArrow(_owner(size), "fid long, bucket long, verdict binary")
    # verdicts are a byte for each entry
    return log.select("fid", "bucket", "counts", "dk", "lo", "hi").join(owned, ["fid", "bucket"]).drop("fid", "bucket").mapInArrow(_answers(bool(size)), "dk long, kind int, lo int, hi int")


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): each document without its repeated passages."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("dk", F.xxhash64("doc_id", "text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = power_of_two(max(8, size / BUCKET_BYTES)).bit_length() - 1
    seeds = materialize(plain.select("dk", "text").mapInArrow(_seeds(window, bits), LOG_KINDS), "substring-seeds")
    found = materialize(_decided(seeds, window), "substring-extents")
    extent = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    opened = materialize(found.where("kind = 2").distinct().groupBy("dk").agg(F.collect_list(extent).alias("open")), "substring-open")
    texts = plain.select("dk", "text").join(bounded(opened, F.size("open") * 8 + 48), "dk")
    counted = materialize(texts.select("dk", "text", "open").mapInArrow(_count_windows(window, bits), LOG_KINDS), "substring-windows")
    more = _decided(counted, None)
    spans = materialize(found.where("kind = 1").select("dk", "lo", "hi").unionByName(more.select("dk", "lo", "hi")).distinct().groupBy("dk").agg(F.collect_list(extent).alias("spans")), "substring-spans")
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return plain.join(bounded(spans, F.size("spans") * 8 + 48), "dk", "left").select("doc_id", "text", "spans").mapInArrow(_cut(window, with_text), kinds)
