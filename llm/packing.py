"""Best-fit-decreasing packing of token sequences into windows.

Overlong documents are first cut into full windows while they are encoded; each full window is a sequence of its own.
The rest go, longest first, to the open window with the least room that still holds them; a segment tree over the
remaining capacities finds it in log2(window) steps. Packing runs in hash groups of some GROUP pieces, each of which
leaves about one window open, so padding stays near half a window for each group whatever the input's size.

Defined results: a null text counts as empty and gives the end id alone; repeated rows are documents of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.encode import pieces
from llm.shared import materialize

WINDOW, GROUP = 4096, 4096


class Capacities:
    """A segment tree over capacities 0..n: how many open windows have each; tightest(x) is the least capacity >= x in use."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, least: int) -> int:
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:  # up to the first right sibling with an open window, then down its left edge
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset there) of each length, which come longest first."""
    tree, open_at, used, to, at = Capacities(window), [[] for _ in range(window + 1)], [], [], []
    for n in lengths:
        room = tree.tightest(n)
        if room < 0:
            w, room = len(used), window
            used.append(0)
        else:
            w = open_at[room].pop()
            tree.add(room, -1)
        to.append(w)
        at.append(used[w])
        used[w] += n
        if room > n:
            open_at[room - n].append(w)
            tree.add(room - n, 1)
    return to, at


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padding (and ids) for each piece."""
    cut = materialize(pieces(docs, tokenizer, end_id, window, with_ids), "packing-pieces")
    n_groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(n_groups)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        lengths = table["length"].to_pylist()
        to, at = best_fit(lengths, window)
        tokens = np.bincount(to, weights=lengths).astype(np.int64)[to]
        base = table["group"][0].as_py() << 32
        pad = np.where(tokens & (tokens - 1), window - tokens, 0)
        extra = {"sequence_id": np.array(to, np.int64) + base, "offset": np.array(at, np.int64), "sequence_tokens": tokens, "padding": pad}
        out = table.select(names)
        for n, v in extra.items():
            out = out.append_column(n, pa.array(v, pa.int64()))
        return out

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return dealt.groupBy("group").applyInArrow(fill, kinds + ", sequence_id long, offset long, sequence_tokens long, padding long")


def sequences(packed: DataFrame, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """sequence_id, ids (padded with `end_id`) and n_tokens from pack(..., with_ids=True)."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        ids = b"".join(table["ids"].to_pylist())
        n = len(ids) // 4
        pad = 0 if n & (n - 1) == 0 else window - n
        return pa.table({"sequence_id": [table["sequence_id"][0].as_py()], "ids": [ids + np.full(pad, end_id, "<u4").tobytes()], "n_tokens": [n]})

    return packed.groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids binary, n_tokens long")
