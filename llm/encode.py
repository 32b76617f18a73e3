"""Token ids of whole texts with a tokenizers file, encoding each distinct word of a worker once.

The library encodes; where the file's rules split text into words that are encoded alone (the word-end BPE files),
texts of plain characters are split here at white space and runs met before are looked up, new ones by their words.
Any other text, and any other file, goes through the library whole, so ids are always those of the library's own encode().
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from llm.kernel import KEPT, drop_kept, release, slices

#: The rules under which words are encoded alone (fixed values of the file format).
WORD_RULES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters for which the library decides: above U+02FF, controls, numbers that aren't digits, letters with odd lower case, special tokens.
UNUSUAL, SPECIAL = re.compile("[^\\t-\\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u02ff]"), "<|"
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Bytes of a generation of each cache, by estimate: ENTRY for a string besides its characters and ids.
RUNS, WORDS, ENTRY = 32 << 20, 16 << 20, 150
#: Words that the library takes at once, and bytes of text whose words are held at once.
CHUNK, SLICE = 2000, 1 << 18


class Cache:
    """Values of strings in two generations: a full young one (over `limit` bytes) becomes the old one, from which strings that
    are met again come back. So common strings stay, rare ones go, and neither generation is gone through."""

    def __init__(self, learn, limit: int):
        self.learn, self.limit, self.size = learn, limit, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def meet(self, lists: list[list[str]]) -> None:
        """Afterwards all strings of the lists are in `young`."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
            release()
        young, old = self.young, self.old
        new = [w for w in set().union(*lists) if w not in young]
        young.update((w, old.pop(w)) for w in new if w in old)
        if rest := [w for w in new if w not in young]:
            young.update(self.learn(rest))
        self.size += sum(ENTRY + len(w) + len(young[w]) for w in new)


class Encoder:
    """encode(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        rules = json.loads(spec)
        kinds = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and bool(splits) and splits[0].get("pattern") == {"Regex": WORD_RULES} and rules["model"].get("end_of_word_suffix") == "</w>" and not rules["model"].get("dropout")
        if self.by_word:
            vocab = rules["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
            rules |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, splits[1]]}}
            self.words = Tokenizer.from_str(json.dumps(rules))
        #: Ids of runs between white space, and of the words of which runs of several are made.
        self.words_met, self.runs_met = Cache(self.learn_words, WORDS), Cache(self.learn_runs, RUNS)

    def learn_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for i in range(0, len(words), CHUNK):
            part = words[i : i + CHUNK]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                yield from ((w, np.array(self.words.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in part)
                continue
            raw, cuts = ids.tobytes(), (ends * 4).tolist()
            yield from ((w, raw[a:b]) for w, a, b in zip(part, [0, *cuts], cuts))

    def learn_runs(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        parts = [(r, WORD.findall(r)) for r in runs]
        yield from self.learn_words([r for r, p in parts if len(p) == 1])  # a run of one word is that word
        if several := [(r, p) for r, p in parts if len(p) != 1]:
            self.words_met.meet([p for _, p in several])
            get = self.words_met.young.__getitem__
            yield from ((r, b"".join(map(get, p))) for r, p in several)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split: list[list[str] | None] = []
        odd: list[str] = []
        for t in texts:
            t = t or ""
            if self.by_word and SPECIAL not in t and not UNUSUAL.search(t):
                split.append(t.lower().split())
            else:
                split.append(None)
                odd.append(t)
        self.runs_met.meet([s for s in split if s])
        rest = iter(self.whole.encode_batch(odd, add_special_tokens=False) if odd else [])
        get = self.runs_met.young.__getitem__
        return [np.array(next(rest).ids, "<u4").tobytes() if s is None else b"".join(map(get, s)) for s in split]


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(shared) -> Encoder:
    """One encoder for each Python worker and tokenizer; text_slices() keeps it, and tasks of other steps drop it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    spec = shared.value
    key = ("encoder", hash(spec))
    if key not in KEPT:
        drop_kept()
        KEPT[key] = Encoder(spec)
    return KEPT[key]


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, limit=SLICE, keep=True)


def share(spark: SparkSession, path: str):
    """The tokenizer file (a few MB) as a broadcast variable."""
    return spark.sparkContext.broadcast(tokenizer_text(path))


def pieces(docs: DataFrame, path: str, end_id: int, window: int | None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian unsigned 32-bit): each document's ids with
    `end_id` after them, cut into full windows and a rest if `window` is given."""
    spec = share(docs.sparkSession, path)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    types = [pa.int64()] * 5 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        for part in text_slices(batches):
            rows = []
            for k, ids in zip(part["doc_id"].to_pylist(), enc.encode(part["text"].to_pylist())):
                ids += end
                step = 4 * window if window else len(ids)
                for i in range(0, len(ids), step):
                    cut = ids[i : i + step]
                    rows.append((k, i // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4) + ((cut,) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
