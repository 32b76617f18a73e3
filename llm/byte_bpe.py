"""Byte-level BPE of whole texts by a rank file, as a tree of joins, and back.

Encoding is a reduction over halves on two levels. A text is halved down to leaves that the pattern splits into matches; two
neighbours are joined by scanning a window at their seam anew. A match's end depends on REACH characters after it, so
matches that end earlier than that before the seam stand, and the scan stops at the first place where a match of the right
part begins too: from there both scans are the same. A match is halved down to leaves of LEAF bytes that are merged by rank;
two neighbours are joined by merging the bytes of a window at their seam anew, growing it until the tokens at its ends stand
beside the tokens outside. That is a proof: a sequence in which each two neighbours encode to themselves is the encoding,
since the first merge across any seam would be the first of that pair too. Decoding concatenates pieces of bytes up a tree.

Nothing moves between tasks; the ranks (a file of a few MB) are broadcast, and a worker keeps at most CACHE short matches.

Defined results: a null or empty text has no ids and decodes to no bytes; texts are encoded whole, very long ones in
leaves, in memory in proportion to the row; special tokens' strings are plain text; of two merges of one rank the left
one comes first; rows that repeat are encoded each, a null doc_id goes through; an empty table gives an empty table;
columns other than doc_id and text, of any name, play no part. Ids that the ranks don't have raise KeyError on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.kernel import slices

LEAF_CHARS, LEAF, PLAIN = 4096, 32, 96
#: How many characters after its end a match of the pattern can depend on: the two letters of 're, or the end of a run of
#: spaces and the character that follows.
REACH = 2
CACHE, SHORT, NEVER = 1 << 19, 64, 1 << 40
_codecs: dict[int, "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Pairs(dict):
    """The rank of the token that two neighbours (left << 24 | right) make, NEVER if none."""

    def __init__(self, ranks: dict[bytes, int], token: dict[int, bytes]):
        super().__init__()
        self.ranks, self.token = ranks, token

    def __missing__(self, key: int) -> int:
        rank = self[key] = self.ranks.get(self.token[key >> 24] + self.token[key & 0xFFFFFF], NEVER)
        return rank


class Matches(dict):
    """The ids, as bytes, of short matches met before."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, match: str) -> bytes:
        ids = np.array(self.codec.match_ids(match.encode("utf-8")), "<u4").tobytes()
        if len(match) <= SHORT:
            self[match] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, reach: int = REACH):
        import regex

        self.ranks, self.reach, self.findall = ranks, reach, regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs, self.known = Pairs(ranks, self.token), Matches(self)
        self.beside: dict[int, bool] = {}

    # merges by rank

    def merge(self, raw: bytes) -> list[int]:
        """The ids of some bytes by merging the pair of least rank, the left one of equals, as long as there is one."""
        if len(raw) > PLAIN:
            return self.merge_many(raw)
        pairs = self.pairs
        ids = [self.single[b] for b in raw]
        rank = [pairs[a << 24 | b] for a, b in zip(ids, ids[1:])]
        while rank:
            least = min(rank)
            if least == NEVER:
                break
            i = rank.index(least)
            ids[i : i + 2] = [least]
            del rank[i]
            if i:
                rank[i - 1] = pairs[ids[i - 1] << 24 | least]
            if i < len(rank):
                rank[i] = pairs[least << 24 | ids[i + 1]]
        return ids

    def merge_many(self, raw: bytes) -> list[int]:
        """The same for long windows, with a heap over linked places."""
        pairs, n = self.pairs, len(raw)
        ids, after, before = [self.single[b] for b in raw], [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs[ids[i] << 24 | ids[i + 1]]) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:  # one of the two has been merged since
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := pairs[rank << 24 | ids[after[i]]]) != NEVER:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0 and (r := pairs[ids[before[i]] << 24 | rank]) != NEVER:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return [x for x in ids if x >= 0]

    # the tree inside a match

    def stand(self, a: int, b: int) -> bool:
        """Whether two neighbours encode to themselves."""
        key = a << 24 | b
        if (known := self.beside.get(key)) is None:
            if len(self.beside) > CACHE:
                self.beside.clear()
            known = self.beside[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        a = b = 1
        while True:
            window = left[-a:] + right[:b]
            ids = self.merge(b"".join(self.token[i] for i in window))
            left_holds = a >= len(left) or ids[0] == left[-a] or self.stand(left[-a - 1], ids[0])
            right_holds = b >= len(right) or ids[-1] == right[b - 1] or self.stand(ids[-1], right[b])
            if left_holds and right_holds:
                return left[:-a] + ids + right[b:]
            a, b = (a if left_holds else 2 * a), (b if right_holds else 2 * b)

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.merge(raw)
        half = 1 << (len(raw) - 1).bit_length() - 1  # runs of one byte are merged at powers of two
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def match_ids(self, raw: bytes) -> list[int]:
        """A match that is a token as it stands is that token."""
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.tree(raw)

    # the tree over a text

    def seam(self, left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
        """Two neighbours, lists of runs of matches, joined."""
        tail: list[str] = []
        size = 0  # characters of the left part from the first match taken back
        while left and size < self.reach:
            tail.insert(0, left[-1].pop())
            size += len(tail[0])
            if not left[-1]:
                left.pop()
        head: list[str] = []
        begins, at, more = set(), size, 4
        while True:
            while right and more:
                head.append(right[0].pop(0))
                begins.add(at)
                at += len(head[-1])
                more -= 1
                if not right[0]:
                    right.pop(0)
            begins.add(at)
            scan, end, kept = self.findall("".join(tail) + "".join(head)), 0, []
            for match in scan:
                if end in begins:
                    break
                end += len(match)
                kept.append(match)
                if right and end + self.reach > at:  # the window's own end decides here
                    break
            if end in begins and (not right or end + self.reach <= at) or not right:
                rest, place = [], size
                for match in head:
                    if place >= end:
                        rest.append(match)
                    place += len(match)
                return left + [kept + rest] + right
            more = 2 * len(head)

    def matches(self, text: str) -> list[list[str]]:
        if len(text) <= LEAF_CHARS:
            return [self.findall(text)] if text else []
        half = len(text) // 2
        return self.seam(self.matches(text[:half]), self.matches(text[half:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        for memo in (self.known, self.pairs):
            if len(memo) > CACHE:
                memo.clear()
        ids = self.known.__getitem__
        return b"".join([b"".join(map(ids, run)) for run in self.matches(text)])

    def decode(self, ids: bytes) -> bytes:
        every, token = np.frombuffer(ids, "<u4").tolist(), self.token.__getitem__
        parts = [b"".join(map(token, every[i : i + LEAF_CHARS])) for i in range(0, len(every), LEAF_CHARS)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def codec(shared) -> Codec:
    """One codec for each Python worker and rank file."""
    ranks, pattern, key = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def share(docs: DataFrame, ranks: dict[bytes, int], pattern: str):
    return docs.sparkSession.sparkContext.broadcast((ranks, pattern, hash((pattern, tuple(sorted(ranks.items()))))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of each row."""
    shared = share(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared)
        for part in slices(batches):
            ids = [own.encode(t or "") for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, decoded (binary: the bytes of the text) of rows with ids as encode() gives them."""
    shared = share(encoded, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared)
        for part in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([own.decode(x or b"") for x in part["ids"].to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded again."""
    shared = share(docs, ranks, pattern)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared)
        for part in slices(batches):
            rows = []
            for text in part["text"].to_pylist():
                ids = own.encode(text or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))], names=names)

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
