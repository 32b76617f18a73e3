"""Greedy longest-match word-piece counts in linear time, without building the pieces.

A trie of the vocabulary carries, at each node, a failure link (where matching goes on once the longest pieces of the
node's string are popped) and the number of pieces popped. Links are folded into one table state x byte -> (state,
pieces popped), so each byte of a text costs one lookup. Words of a slice advance together, longest first.

Words are runs of bytes other than space and \\x09-\\x0D, and begin with the marker byte 0x20: pieces that begin a
word begin with it, all others go on inside a word. A word that the vocabulary can't spell counts as one unknown.

Defined results: null, empty and blank texts have no words; repeated rows are counted each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.kernel import Words, slices

ROOT, START, UNKNOWN, STATE_BITS = 0, 1, 2, 24
_automata: dict[int, "Automaton"] = {}


class Automaton:
    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{0x20: START}, {}, {}]
        is_piece = {START: False}
        for piece in pieces:
            at = ROOT
            for byte in piece:
                nxt = children[at].get(byte)
                if nxt is None:
                    nxt = children[at][byte] = len(children)
                    children.append({})
                at = nxt
            if piece:
                is_piece[at] = True
        n = len(children)
        if n >> STATE_BITS:
            raise ValueError("too large a vocabulary")
        link, popped = np.full(n, UNKNOWN), np.zeros(n, np.int64)
        self.rest = np.full(n, -1, np.int64)  # pieces popped when a word ends at the state; -1: it can't be spelled
        self.rest[ROOT] = 0
        self.table = np.full((n, 256), UNKNOWN, np.int32)
        self._row(ROOT, children, self.table[ROOT])
        level = [ROOT]
        while level:
            below = []
            for u in level:
                for byte, v in children[u].items():
                    below.append(v)
                    if is_piece.get(v):
                        link[v], popped[v] = ROOT, 1
                    elif u != ROOT:
                        z, count = link[u], popped[u]
                        while z != UNKNOWN and byte not in children[z]:
                            count += popped[z]
                            z = link[z]
                        if z != UNKNOWN:
                            link[v], popped[v] = children[z][byte], count
                    if link[v] != UNKNOWN:
                        row = self.table[link[v]]
                        self.table[v] = np.where(row & ((1 << STATE_BITS) - 1) == UNKNOWN, UNKNOWN, row + (int(popped[v]) << STATE_BITS))
                        if self.rest[link[v]] >= 0:
                            self.rest[v] = popped[v] + self.rest[link[v]]
                    self._row(v, children, self.table[v])
            level = below

    @staticmethod
    def _row(v: int, children: list[dict[int, int]], row: np.ndarray) -> None:
        for byte, to in children[v].items():
            row[byte] = to

    def counts(self, w: Words) -> np.ndarray:
        """Pieces of each word."""
        size = w.end - w.start
        order = np.argsort(-size, kind="stable")
        start, size = w.start[order], size[order]
        state, total = np.full(len(order), START, np.int64), np.zeros(len(order), np.int64)
        flat, mask = self.table.reshape(-1), (1 << STATE_BITS) - 1
        j, n = 0, len(order)
        while n:
            n = int(np.searchsorted(-size[:n], -j))  # words longer than j
            if n <= 32:
                break
            step = flat[(state[:n] << 8) + w.data[start[:n] + j]]
            state[:n] = step & mask
            total[:n] += step >> STATE_BITS
            j += 1
        for i in range(n):
            s, t = int(state[i]), 0
            for byte in w.data[start[i] + j : start[i] + size[i]].tolist():
                step = int(flat[(s << 8) + byte])
                s, t = step & mask, t + (step >> STATE_BITS)
            state[i], total[i] = s, total[i] + t
        total = np.where(self.rest[state] < 0, 1, total + self.rest[state])
        out = np.empty_like(total)
        out[order] = total
        return out


def byte_level_pieces(spec: str) -> list[bytes]:
    """Pieces of a byte-level BPE file: its printable stand-ins turned back into bytes; a leading space begins a word."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    rules = json.loads(spec)
    special = {t["content"] for t in rules.get("added_tokens", []) if t.get("special")}
    return [bytes(back[c] for c in piece) for piece in rules["model"]["vocab"] if piece not in special]


def automaton(pieces: list[bytes]) -> Automaton:
    key = hash(tuple(pieces))
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(pieces)
    return _automata[key]


def token_counts(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens of each row. `pieces` (a vocabulary, a few MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for part in slices(batches):
            w = Words(part["text"])
            total = np.concatenate([[0], np.cumsum(machine.counts(w))])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(w.first)), pa.array(total[w.first[1:]] - total[w.first[:-1]])], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
