"""Token ids in binary shards with a minimal perfect hash index from document keys to offsets.

A shard is a run of documents in ascending doc_id order. `shard-N.ids` holds the raw ids, two bytes each where the
vocabulary allows, else four. `shard-N.idx` holds the records (doc_id, offset) and the index: level bit arrays with
ranks map a key to a slot without collision; the slot has a 32-bit fingerprint and the record's number, so a lookup
costs a few probes and one fingerprint test whatever the shard's size. Files are written under a task's own name and
then renamed, so a lost or repeated task leaves whole files only.

Defined results: a null text is the end id alone; rows that repeat a doc_id are records of their own, next to each
other, and a lookup gives all of them; rows with a null doc_id come first and have no key; an empty table gives no
shards; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.encode import encoder, share, text_slices
from llm.kernel import mix
from llm.shared import scratch

MAGIC, GAMMA, LEVELS, SHARD_BYTES = b"IDSHARD1", 2.0, 24, 24 << 20


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: on each level, keys alone at their place get the place's rank."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, rest: np.ndarray):
        self.bits, self.sizes, self.rest = bits, sizes, rest
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # ranks of every 64th place; those between are counted in the word
        padded = np.zeros(-(-len(bits) // 8) * 8, np.uint8)
        padded[: len(bits)] = bits
        self.words = padded.view("<u8")
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.n = int(self.ranks[-1]) + len(rest)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        left, parts, sizes = keys.astype(np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-int(GAMMA * len(left) + 8) // 8) * 8
            at = cls.place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.packbits(np.concatenate(parts), bitorder="little") if parts else np.zeros(0, np.uint8), np.array(sizes, np.int64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the key certainly isn't in the set."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.place(keys[open_], level, int(size)) + self.base[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.ranks[at[hit] >> 6] + below
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[i] == keys[open_]
            out[open_[hit]] = self.ranks[-1] + i[hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


def store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def dump_index(doc_ids: np.ndarray, known: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    keys, first = np.unique(doc_ids[known], return_index=True)
    first = np.flatnonzero(known)[first]
    ph = PerfectHash.build(keys.view(np.uint64))
    slots = ph.slots(keys.view(np.uint64))
    prints, records = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i8")
    prints[slots], records[slots] = fingerprint(keys.view(np.uint64)), first
    arrays = {"doc_ids": doc_ids.astype("<i8"), "known": known.astype("u1"), "offsets": offsets.astype("<i8"), "bits": ph.bits, "sizes": ph.sizes.astype("<i8"), "rest": ph.rest.astype("<u8"), "prints": prints, "records": records}
    head = json.dumps({"width": width, "arrays": [[n, a.dtype.str, len(a)] for n, a in arrays.items()]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays.values())


class Shard:
    """One shard, opened for keyed or sequential access."""

    def __init__(self, uri: str):
        self.fs, self.path = store(uri)
        with self.fs.open_input_stream(f"{self.path}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"not an index: {uri}")
        size = int.from_bytes(raw[8:12], "little")
        head, at = json.loads(raw[12 : 12 + size]), 12 + size
        a = {}
        for n, kind, k in head["arrays"]:
            a[n] = np.frombuffer(raw, np.dtype(kind), k, at)
            at += a[n].nbytes
        self.width, self.doc_ids, self.known, self.offsets = head["width"], a["doc_ids"], a["known"].astype(bool), a["offsets"]
        self.prints, self.records = a["prints"], a["records"]
        self.hash = PerfectHash(a["bits"], a["sizes"], a["rest"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 where the fingerprint or the record says that it isn't here."""
        keys = np.asarray(keys, np.int64)
        slot = self.hash.slots(keys.view(np.uint64))
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok].view(np.uint64))
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.records[slot[ok]]
        ok[ok] = self.doc_ids[out[ok]] == keys[ok]
        return np.where(ok, out, -1)

    def read(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of records first..last-1 as unsigned 32-bit numbers."""
        lo, hi = int(self.offsets[first]), int(self.offsets[last])
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            ids = np.frombuffer(f.read_at((hi - lo) * self.width, lo * self.width), f"<u{self.width}").astype("<u4")
        return np.split(ids, self.offsets[first + 1 : last] - lo)

    def get(self, key: int) -> list[np.ndarray]:
        first = int(self.find(np.array([key]))[0])
        if first < 0:
            return []
        last = first
        while last < len(self.doc_ids) and self.doc_ids[last] == key and self.known[last]:
            last += 1
        return self.read(first, last)


@dataclass
class IdFiles:
    """What write_ids wrote: for each shard (number, uri, records, ids, least and greatest doc_id) and its first id's place."""

    spark: object
    shards: list[tuple]

    def frame(self) -> DataFrame:
        start, rows = 0, []
        for number, uri, _, n, _, _ in self.shards:
            rows.append((number, uri, start))
            start += n
        return self.spark.createDataFrame(rows, "shard int, uri string, start long").repartition(max(1, len(rows)), "shard")

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of each record, found through the index and read from the files."""
        return self.frame().mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def get(self, key: int) -> list[np.ndarray]:
        return [ids for _, uri, _, _, lo, hi in self.shards if lo is not None and lo <= key <= hi for ids in Shard(uri).get(key)]


def read_shards(batches: Iterator[pa.RecordBatch], step: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist()):
            shard = Shard(uri)
            n = len(shard.doc_ids)
            found = shard.find(shard.doc_ids)
            if not (shard.doc_ids[found[shard.known]] == shard.doc_ids[shard.known]).all() or (found[shard.known] < 0).any():
                raise ValueError(f"the index of {uri} misses keys")
            for i in range(0, n, step):
                j = min(n, i + step)
                crc = [zlib.crc32(x.tobytes()) for x in shard.read(i, j)]
                keys = pa.array(shard.doc_ids[i:j], mask=~shard.known[i:j])
                yield pa.RecordBatch.from_arrays([keys, pa.array(shard.offsets[i:j] + start), pa.array(np.diff(shard.offsets[i : j + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> IdFiles:
    """Encode every text, append `end_id`, and write shards in ascending doc_id order."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "id-files")
    spec = share(spark, tokenizer)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    # the second key splits rows that repeat one doc_id
    dealt = plain.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    names = ["shard", "uri", "records", "ids", "least", "greatest"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        enc = encoder(spec)
        width = 2 if max(enc.whole.get_vocab_size(), end_id) < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        mine, final = f"{root}/.{number}-{uuid.uuid4().hex}", f"{root}/shard-{number:06d}"
        doc_ids, known, lengths = [], [], []
        with fs.open_output_stream(f"{mine}.ids") as f:
            for part in text_slices(batches):
                for k, ids in zip(part["doc_id"].to_pylist(), enc.encode(part["text"].to_pylist())):
                    ids = np.frombuffer(ids + end, "<u4")
                    f.write(ids.astype(f"<u{width}").tobytes())
                    doc_ids.append(k or 0)
                    known.append(k is not None)
                    lengths.append(len(ids))
        if not doc_ids:
            fs.delete_file(f"{mine}.ids")
            return
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        doc_ids, known = np.array(doc_ids, np.int64), np.array(known, bool)
        with fs.open_output_stream(f"{mine}.idx") as f:
            f.write(dump_index(doc_ids, known, offsets, width))
        for kind in ("ids", "idx"):
            fs.move(f"{mine}.{kind}", f"{final}.{kind}")
        keys = doc_ids[known]
        row = (number, f"{folder}/shard-{number:06d}", len(doc_ids), int(offsets[-1]), int(keys.min()) if len(keys) else None, int(keys.max()) if len(keys) else None)
        yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64())]))

    # one row for each shard comes back
    rows = dealt.mapInArrow(write, "shard int, uri string, records long, ids long, least long, greatest long").collect()
    return IdFiles(spark, sorted(tuple(r) for r in rows))
