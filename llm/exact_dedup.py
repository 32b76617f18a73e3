"""Exact deduplication through an extendible-hash index on shared files.

Map tasks fold equal texts of their rows into entries and write them to the shared folder once. A directory,
doubled until no bucket is overfull, splits the key space; owner tasks take whole buckets, walk their entries in
key order, chain texts whose keys collide and compare bytes. Their verdicts are the index's pages, also shared
files. A text copied a billion times reaches its owner once for each map flush, never once for each row.

Defined results: a null text counts as empty; an empty table gives an empty result; rows that repeat a doc_id count
each, and one of them stays; of ties the smallest id stays; a null doc_id stays only if its group has no other id; very long
texts are hashed and compared whole; other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.kernel import release, slices, task
from llm.shared import materialize

#: Whitespace runs that one space would change.
LOOSE = re.compile(r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")
ID_BYTES = 40  # an id in a list: its place and its object
FLUSH_BYTES, CAPACITY, PROBE_BITS, MAX_BITS = 16 << 20, 4096, 12, 48
ENTRY = pa.schema([("fid", pa.int64()), ("idx", pa.int32()), ("key", pa.int64()), ("sha", pa.string()), ("norm", pa.string()), ("min_id", pa.int64()), ("keep_pos", pa.int32()), ("ids", pa.list_(pa.int64()))])
PAGE = "fid long, idx int, bucket long, chain int, keep_id long, group_size long, keeper boolean"


def normalize(text: str | None) -> str:
    return LOOSE.sub(" ", text or "")


def entries_of(key_bits: int):
    """Equal texts of a task become one entry with the ids of their rows; flushed at FLUSH_BYTES of texts and ids, so one text
    repeated without end is several entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fid, seen, size = task(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = {n: [] for n in ENTRY.names}
            for i, (norm, ids) in enumerate(seen.items()):
                digest = hashlib.sha256(norm.encode()).digest()
                best = min((k for k in ids if k is not None), default=None)
                row = (fid, i, int.from_bytes(digest[:8], "big") >> (64 - key_bits) << (64 - key_bits), digest.hex(), norm, best, ids.index(best), ids)
                for n, v in zip(ENTRY.names, row):
                    out[n].append(v - (1 << 64) if n == "key" and v >> 63 else v)
            for i in range(0, len(seen), 2000):
                yield pa.RecordBatch.from_pydict({n: v[i : i + 2000] for n, v in out.items()}, schema=ENTRY)

        for part in slices(batches):
            for k, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                norm = normalize(t)
                if norm in seen:
                    seen[norm].append(k)
                    size += ID_BYTES
                else:
                    seen[norm] = [k]
                    size += len(norm) + 64 + ID_BYTES
            if size > FLUSH_BYTES:
                yield from flush()
                fid, seen, size = fid + 1, {}, 0
        yield from flush()

    return run


@dataclass
class Directory:
    """Slots of an extendible hash: `buckets` maps (local depth, prefix) to a bucket number; `depth` is the global depth."""

    depth: int
    buckets: list[tuple[int, int]]

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(d, p, i) for i, (d, p) in enumerate(self.buckets)], "local_depth int, prefix long, bucket long")


def split(counts: dict[int, int], bits: int, capacity: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Split buckets, doubling the directory as far as `bits`, until none is overfull: (fitting, still overfull)."""
    sums = [counts]
    for _ in range(bits):
        up: dict[int, int] = {}
        for p, n in sums[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        sums.append(up)
    fit, over, stack = [], [], [(0, 0)]
    while stack:
        depth, prefix = stack.pop()
        n = sums[bits - depth].get(prefix, 0)
        if n <= capacity:
            fit.append((depth, prefix))
        elif depth == bits:
            over.append((depth, prefix))
        else:
            stack += [(depth + 1, prefix * 2), (depth + 1, prefix * 2 + 1)]
    return fit, over


def prefix_of(depth: int):
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> Directory:
    """Only counts of key prefixes reach the driver, some 2**PROBE_BITS for each round; equal keys can't be split."""
    distinct = entries.select("key").distinct()
    counts = {r[0]: r[1] for r in distinct.groupBy(prefix_of(PROBE_BITS)).count().collect()}
    done, over = split(counts, PROBE_BITS, capacity)
    depth = PROBE_BITS
    while over and depth < MAX_BITS:
        deeper = min(depth + 8, MAX_BITS)
        held = entries.sparkSession.createDataFrame([(p,) for _, p in over], "held long")
        rows = distinct.join(F.broadcast(held), prefix_of(depth) == F.col("held"), "left_semi").groupBy(prefix_of(deeper)).count().collect()
        by: dict[int, dict[int, int]] = {p: {} for _, p in over}
        for r in rows:
            by[r[0] >> (deeper - depth)][r[0] & ((1 << (deeper - depth)) - 1)] = r[1]
        base, over = depth, []
        for p, c in by.items():
            fit, more = split(c, deeper - base, capacity)
            done += [(base + d, (p << d) | q) for d, q in fit]
            over += [(base + d, (p << d) | q) for d, q in more]
        depth = deeper
    done = sorted(done + over, key=lambda b: b[1] << (64 - b[0]))
    return Directory(max((d for d, _ in done), default=0), done)


def with_bucket(entries: DataFrame, found: Directory) -> DataFrame:
    """The bucket of each key: looked up at each local depth that the directory has, without moving an entry."""
    slots, columns = found.frame(entries.sparkSession), []
    for d in sorted({d for d, _ in found.buckets}):
        own = slots.where(F.col("local_depth") == d).select(F.col("prefix").alias(f"p{d}"), F.col("bucket").alias(f"b{d}"))
        entries = entries.join(F.broadcast(own) if len(found.buckets) < 1 << 20 else own, prefix_of(d) == F.col(f"p{d}"), "left").drop(f"p{d}")
        columns.append(f"b{d}")
    return entries.withColumn("bucket", F.coalesce(*columns, F.lit(0).cast("long"))).drop(*columns)


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in (bucket, key) order: chain the texts of one key, compare bytes, name who stays."""
    schema = pa.schema([("fid", pa.int64()), ("idx", pa.int32()), ("bucket", pa.int64()), ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keeper", pa.bool_())])
    at, chain, rows = None, {}, []

    def close() -> None:
        for c, members in enumerate(chain.values()):
            best = min(members, key=lambda m: (m[0] is None, m[0] or 0, m[2], m[3]))
            total = sum(m[1] for m in members)
            rows.extend((m[2], m[3], at[0], c, best[0], total, m is best) for m in members)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    for batch in batches:
        cols = [batch[n].to_pylist() for n in ("bucket", "key", "norm", "min_id", "n", "fid", "idx")]
        for bucket, key, norm, low, n, fid, idx in zip(*cols):
            if at != (bucket, key):
                if at is not None:
                    close()
                at, chain = (bucket, key), {}
            chain.setdefault(norm, []).append((low, n, fid, idx))
        if len(rows) > 50_000:
            yield out()
            rows.clear()
    if at is not None:
        close()
    yield out()
    release()


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, chain: one row for each row of `docs`.

    `key_bits` below 64 makes keys collide, which only lengthens chains."""
    log = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(entries_of(key_bits), "fid long, idx int, key long, sha string, norm string, min_id long, keep_pos int, ids array<long>"), "dedup-entries")
    found = directory(log, capacity)
    placed = with_bucket(log.select("fid", "idx", "key", "norm", "min_id", F.size("ids").cast("long").alias("n")), found)
    # an owner has whole buckets; entries of one key number at most one for each flush and text
    placed = placed.repartition(F.col("bucket")).sortWithinPartitions("bucket", "key")
    pages = materialize(placed.mapInArrow(own, PAGE), "dedup-pages")
    members = log.select("fid", "idx", "sha", "keep_pos", F.posexplode("ids").alias("pos", "doc_id"))
    rows = members.join(pages, ["fid", "idx"])
    return rows.select("doc_id", "keep_id", "group_size", (F.col("keeper") & (F.col("pos") == F.col("keep_pos"))).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain")
