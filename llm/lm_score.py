"""Language-model scores from a log-frequency Bloom filter.

Counting tasks fold words and pairs of words of the training texts for each flush; owners of key ranges add the counts
up. An owner writes its range's part of the filter: for a key counted c times it enters (key, 1) .. (key, q) where
q = 1 + floor(2 log2 c), so a reader finds q, and with it the count's floor and ceiling, by probing until a probe
fails. Every distinct pair of the corpus is in the filter, which grows with the input. It is broadcast to the workers
while its measured size is within FILTER_BYTES. Beyond that the probes go to the filter: each flush sends its distinct
keys to the tasks of their ranges, which load their one part, and gets a byte back for each, so work and traffic stay
in proportion to the text. Both ways read the same bits and give the same scores.

The model interpolates: P(w|h) = l * min(1, c(h,w)/c(h)) + (1-l) * (c(w)+0.5)/(N+0.5(V+1)), l = c(h)/(c(h)+2), with
filter counts: floors above and ceilings below, so the probabilities of all w sum to 1 at most, false hits aside. All of
its counts, of words and of pairs, of frequent and of rare ones, come from probes of the filter. A text begins after
nothing, which is seen as often as the end token is.

The base score is exact and uses no filter: the HEAD commonest words (a bounded table) are counted in place; the others go to the owners of their range and
their counts come back to the flush that sent them, so frequent words never move. Words and pairs are told apart by
64-bit hashes (in the filter, pairs by 48 bits of one).

Defined results: null, empty and blank texts are the end token alone; repeated rows count and are scored each; a null
id counts as the empty text in the fold; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.kernel import U, Words, mix, slices, task
from llm.shared import fold, materialize, power_of_two, scratch

END, BEGIN = U(0x51ED270B35AE12C5), U(0x7F4A7C159E3779B9)
FLUSH, HEAD, BUCKET_BYTES, FILTER_BYTES, BITS, PROBES, TOP = 2 << 20, 1 << 18, 8 << 20, 96 << 20, 8, 4, 128
ASK = 1 << 19  # tokens of a flush whose probes travel
SHORT = U(16)  # low bits of a pair's key that are dropped


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes first: high bytes of small numbers compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row's tokens with the end after them, the tokens before them, and the first index of each row."""
    w = Words(part["text"], lower=True)
    first = w.first + np.arange(w.rows + 1)
    out = np.full(first[-1], END, U)
    body = np.ones(len(out), bool)
    body[first[1:] - 1] = False
    out[body] = w.hashes()
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first[:-1]] = BEGIN
    return out, before, first


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (mix(before * U(0xD1342543DE82EF95) + word) >> SHORT) << SHORT


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


FLOOR = np.array([0] + [int(np.ceil(2 ** ((q - 1) / 2) - 1e-9)) for q in range(1, TOP + 1)], np.float64)
CEIL = np.array([0] + [max(FLOOR[q], int(np.ceil(2 ** (q / 2) - 1e-9)) - 1) for q in range(1, TOP + 1)], np.float64)


def places(keys: np.ndarray, level: int, size) -> list[np.ndarray]:
    """PROBES bit numbers below `size` (one for all or one for each key; no power of two is needed) for (key, level)."""
    a = mix(keys + U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    b = mix(a) | U(1)
    return [((a + U(i) * b) >> U(32)) * np.asarray(size, U) >> U(32) for i in range(PROBES)]


def room(q: np.ndarray, bits: int) -> int:
    """Bits of a filter part for keys of levels q, at `bits` an entry."""
    return max(64, int(bits * q.sum()))


def fill(keys: np.ndarray, counts: np.ndarray, bits_each: int = BITS) -> np.ndarray:
    """One part of the filter."""
    q = levels(counts)
    size = room(q, bits_each)
    bits = np.zeros(-(-size // 8) * 8, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in places(keys[q >= level], level, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def probe(part: np.ndarray, size, keys: np.ndarray, base=0) -> np.ndarray:
    """The level of each key: probes go on until one fails. `size` and the first bit `base` may differ for each key."""
    q, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
    size, base = np.broadcast_to(np.asarray(size, U), len(keys)), np.broadcast_to(np.asarray(base, U), len(keys))
    for level in range(1, TOP + 1):
        hit = np.ones(len(open_), bool)
        for at in places(keys[open_], level, size[open_]):
            at = at + base[open_]
            hit &= (part[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
        open_ = open_[hit]
        if not len(open_):
            break
        q[open_] = level
    return q


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U(64 - bits)).astype(np.int64)


def _fold(bits: int):
    names = ["bucket", "kind", "gaps", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if not held[kind]:
                    continue
                keys, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
                rows, at = np.unique(_bucket(keys, bits), return_index=True)
                cols = [rows.tolist(), [kind] * len(rows), [], []]
                for i, j in zip(at.tolist(), [*at[1:].tolist(), len(keys)]):
                    cols[2].append(planes(np.diff(keys[i:j] >> SHORT if kind else keys[i:j], prepend=U(0))))
                    cols[3].append(planes(counts[i:j].astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=names)
                held[kind].clear()

        n = 0
        for part in slices(batches):
            word, before, _ = tokens(part)
            held[0].append(word)
            held[1].append(pair(before, word))
            n += len(word)
            if n >= FLUSH:
                yield from flush()
                n = 0
        yield from flush()

    return run


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[begin], np.add.reduceat(c, begin)


OWNED = "bucket long, distinct long, tokens long, gaps binary, counts binary, by_level array<long>, bytes long"


def _own(folder: str, bits_each: int):
    """Sum a range's counts and write its part of the filter; a repeated task writes the same bytes again."""

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[list, list]] = [([], []), ([], [])]
        for kind, gaps, counts in zip(*(table[c].to_pylist() for c in ("kind", "gaps", "counts"))):
            keys = np.cumsum(unplanes(gaps, "<u8"), dtype=U)
            found[kind][0].append(keys << SHORT if kind else keys)
            found[kind][1].append(unplanes(counts, "<u4"))
        (words, n), (pairs, m) = _add(*found[0]), _add(*found[1])
        both = np.concatenate([n, m])
        part, size = fill(np.concatenate([word_key(words), pairs]), both, bits_each), room(levels(both), bits_each)
        bucket = table["bucket"][0].as_py()
        _write(f"{folder}/part-{bucket:06d}", np.array([size], "<u8").tobytes() + part.tobytes())
        row = {"bucket": [bucket], "distinct": [len(words)], "tokens": [int(n.sum())], "gaps": [planes(np.diff(words, prepend=U(0)))], "counts": [planes(n.astype("<u8"))], "by_level": [np.bincount(levels(n), minlength=TOP + 1).tolist()], "bytes": [len(part)]}
        return pa.table(row, schema=pa.schema([("bucket", pa.int64()), ("distinct", pa.int64()), ("tokens", pa.int64()), ("gaps", pa.binary()), ("counts", pa.binary()), ("by_level", pa.list_(pa.int64())), ("bytes", pa.int64())]))

    return run


def word_key(words: np.ndarray) -> np.ndarray:
    """The filter's key of a word: in the word's own range, apart from pairs."""
    return words ^ U(0x5A)


def _write(uri: str, raw: bytes) -> None:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    mine = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with where.open_output_stream(mine) as f:
        f.write(raw)
    where.move(mine, path)


def _read(uri: str) -> tuple[int, np.ndarray]:
    """A part of the filter: its number of bits, and the bits."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path) as f:
        raw = f.read()
    return int(np.frombuffer(raw, "<u8", 1)[0]), np.frombuffer(raw, np.uint8, offset=8)


@dataclass
class Model:
    folder: str
    bits: int  # of the range numbers
    filter: np.ndarray | None  # all parts one after another, if they are within their bound
    sizes: np.ndarray | None  # bits of each range's part, 0 for a range without keys
    begins: np.ndarray | None  # first bit of each range's part
    head: np.ndarray
    head_counts: np.ndarray
    tokens: int
    distinct: int

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys by the filter in memory, all ranges in one pass."""
        bucket = _bucket(keys, self.bits)
        have = np.flatnonzero(self.sizes[bucket])
        out = np.zeros(len(keys), np.int64)
        out[have] = probe(self.filter, self.sizes[bucket[have]], keys[have], self.begins[bucket[have]])
        return out

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether the head table has it) of each word."""
        if not len(self.head):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        i = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        hit = self.head[i] == words
        return np.where(hit, self.head_counts[i], 0), hit

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def train(docs: DataFrame, size: int, head: int = HEAD, filter_bytes: int = FILTER_BYTES, bits_each: int = BITS) -> tuple[Model, DataFrame]:
    """The model and the exact word counts by range."""
    bits = power_of_two(max(16, size / BUCKET_BYTES)).bit_length() - 1
    folder = scratch(docs.sparkSession, "lm-filter")
    folded = docs.select("text").mapInArrow(_fold(bits), "bucket long, kind int, gaps binary, counts binary")
    owned = materialize(folded.groupBy("bucket").applyInArrow(_own(folder, bits_each), OWNED), "lm-counts")
    sums = owned.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "tokens", "bytes")]).first()
    by_level = {r[0]: r[1] for r in owned.select(F.posexplode("by_level").alias("q", "n")).groupBy("q").agg(F.sum("n")).collect()}
    least, left = TOP + 1, head
    while least > 1 and by_level.get(least - 1, 0) <= left:
        least -= 1
        left -= by_level.get(least, 0)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gaps, counts in zip(batch["gaps"].to_pylist(), batch["counts"].to_pylist()):
                keys, c = np.cumsum(unplanes(gaps, "<u8"), dtype=U), unplanes(counts, "<u8").astype(np.int64)
                keep = levels(c) >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(c[keep])], names=["word", "n"])

    top = owned.select("gaps", "counts").mapInArrow(frequent, "word long, n long").toArrow()
    words, n = top["word"].to_numpy().view(U), top["n"].to_numpy()
    order = np.argsort(words)
    whole = sizes = begins = None
    if sums["bytes"] <= filter_bytes:
        sizes, begins, parts, end = np.zeros(1 << bits, U), np.zeros(1 << bits, U), [], 0
        for (bucket,) in owned.select("bucket").collect():
            size, part = _read(f"{folder}/part-{bucket:06d}")
            sizes[bucket], begins[bucket] = size, 8 * end
            parts.append(part)
            end += len(part)
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return Model(folder, bits, whole, sizes, begins, words[order], n[order], sums["tokens"], sums["distinct"]), owned


SCORED = ["fid", "local", "doc_id", "held_out", "n_tokens", "head_known", "head_score", "score", "bucket", "rows", "gaps"]
SCORED_KINDS = "fid long, local int, doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, score double, bucket long, rows binary, gaps binary"
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0, values.dtype)


def _batch(n: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(SCORED, TYPES)], names=SCORED)


def filter_keys(words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return np.concatenate([word_key(words), pairs])


def _rows(model: Model, part: pa.RecordBatch, level, fid: int, local: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The texts' rows; for words that the head table lacks, their texts' numbers and the words."""
    word, before, first = tokens(part)
    n = part.num_rows
    row = np.repeat(np.arange(n), np.diff(first))
    words, of = np.unique(word, return_inverse=True)
    count, hit = model.known(words)
    pairs, of_pair = np.unique(pair(before, word), return_inverse=True)
    q = level(filter_keys(words, pairs))
    low, high, both = FLOOR[q[: len(words)]], CEIL[q[: len(words)]], FLOOR[q[len(words) :]][of_pair]
    context = np.empty(len(word))
    context[1:] = high[of][:-1]
    context[first[:-1]] = high[of[first[1:] - 1]]
    weight = context / (context + 2)
    p = weight * np.minimum(1.0, both / np.maximum(context, 1)) + (1 - weight) * ((low + 0.5) / model.total)[of]
    base = np.where(hit, np.log10((count + 0.5) / model.total), 0.0)[of]
    out = _batch(n, fid=[fid] * n, local=range(local, local + n), doc_id=part["doc_id"].to_pylist(), held_out=part["held_out"].to_pylist(), n_tokens=np.diff(first), head_known=_per_row(hit[of].astype(np.int64), first), head_score=_per_row(base, first), score=_per_row(np.log10(p), first))
    rest = ~hit[of]
    return out, row[rest] + local, word[rest]


def _tail(model: Model, fid: int, rows: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """For each range one blob of the words that the head table lacks, with their texts' numbers."""
    order = np.argsort(words, kind="stable")
    rows, words = rows[order], words[order]
    found, at = np.unique(_bucket(words, model.bits), return_index=True)
    ends = list(zip(at.tolist(), [*at[1:].tolist(), len(words)]))
    return _batch(len(found), fid=[fid] * len(found), bucket=found.tolist(), rows=[planes(rows[i:j].astype("<u4")) for i, j in ends[: len(found)]], gaps=[planes(np.diff(words[i:j], prepend=U(0))) for i, j in ends[: len(found)]])


def _score(shared):
    """Rows and tails of texts, with the filter in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        fid, local, tails, n_tail = task(), 0, [], 0
        for part in slices(batches):
            out, rows, words = _rows(model, part, model.level, fid, local)
            yield out
            tails.append((rows, words))
            n_tail, local = n_tail + len(words), local + part.num_rows
            if n_tail >= FLUSH // 2:
                yield _tail(model, fid, *(np.concatenate(x) for x in zip(*tails)))
                fid, local, tails, n_tail = fid + 1, 0, [], 0
        if n_tail:
            yield _tail(model, fid, *(np.concatenate(x) for x in zip(*tails)))

    return run


ASKED = "fid long, doc_id long, held_out boolean, text string, bucket long, gaps binary"


def _ask(bits: int):
    """Each flush's texts, and for each range one blob of the flush's distinct filter keys."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in ASKED.split(", ")]

    def batch(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fid, n, held = task(), 0, []

        def flush() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held))
            found, at = np.unique(_bucket(keys, bits), return_index=True)
            return batch(len(found), fid=[fid] * len(found), bucket=found.tolist(), gaps=[planes(np.diff(keys[i:j], prepend=U(0))) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(keys)])])

        for part in slices(batches):
            yield batch(part.num_rows, fid=[fid] * part.num_rows, **{c: part[c].to_pylist() for c in ("doc_id", "held_out", "text")})
            word, before, _ = tokens(part)
            held.append(filter_keys(np.unique(word), np.unique(pair(before, word))))
            n += len(word)
            if n >= ASK:
                yield flush()
                fid, n, held = fid + 1, 0, []
        if n:
            yield flush()

    return run


def _answer(folder: str):
    """One range's levels for all blobs that ask, a byte for each key."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys = [np.cumsum(unplanes(b, "<u8"), dtype=U) for b in table["gaps"].to_pylist()]
        try:
            size, part = _read(f"{folder}/part-{bucket:06d}")
            q = probe(part, size, np.concatenate(keys)).astype(np.uint8)
        except FileNotFoundError:  # a range without a training key has no part
            q = np.zeros(sum(map(len, keys)), np.uint8)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({"fid": table["fid"], "bucket": table["bucket"], "levels": pa.array([x.tobytes() for x in np.split(q, cuts)], pa.binary())})

    return run


def _score_answered(shared):
    """Rows and tails of one flush's texts, with the levels that its ranges sent back."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        model: Model = shared.value
        q = np.frombuffer(b"".join(answers.sort_by("bucket")["levels"].to_pylist()), np.uint8).astype(np.int64)
        # the flush's distinct keys in ascending order are those that it sent
        level = lambda keys: q[np.unique(keys, return_inverse=True)[1]]
        fid, part = texts["fid"][0].as_py(), texts.select(["doc_id", "held_out", "text"]).combine_chunks().to_batches()[0]
        out, rows, words = _rows(model, part, level, fid, 0)
        return pa.Table.from_batches([out, _tail(model, fid, rows, words)] if len(words) else [out])

    return run


def _look_up(total: float):
    """One range's exact counts for all blobs that ask: each text's sum of logarithms and number of known words."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.filter(pa.compute.is_valid(table["fid"]))
        have = table.filter(pa.compute.is_null(table["fid"])).to_pylist()
        keys = np.cumsum(unplanes(have[0]["gaps"], "<u8"), dtype=U) if have else np.zeros(0, U)
        counts = unplanes(have[0]["rows"], "<u8").astype(np.int64) if have else np.zeros(0, np.int64)
        fids, rows, logs, known = [], [], [], []
        for fid, r, gaps in zip(*(asks[c].to_pylist() for c in ("fid", "rows", "gaps"))):
            words, r = np.cumsum(unplanes(gaps, "<u8"), dtype=U), unplanes(r, "<u4")
            c = np.zeros(len(words), np.int64)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                c = np.where(keys[i] == words, counts[i], 0)
            fids.append(fid)
            rows.append(r.tobytes())
            logs.append(c.astype(np.uint32).tobytes())
        return pa.table({"fid": pa.array(fids, pa.int64()), "rows": pa.array(rows, pa.binary()), "counts": pa.array(logs, pa.binary())})

    return run


def _sum_up(total: float):
    def run(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table["rows"].to_pylist()), np.uint32)
        c = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32).astype(np.float64)
        n = int(rows.max()) + 1
        logs, known = np.bincount(rows, np.log10((c + 0.5) / total), n), np.bincount(rows, c > 0, n)
        at = np.flatnonzero(np.bincount(rows, minlength=n))
        return pa.table({"fid": pa.array(np.full(len(at), table["fid"][0].as_py())), "local": pa.array(at.astype(np.int32)), "tail_score": logs[at], "tail_known": known[at].astype(np.int64)})

    return run


def lm_score(docs: DataFrame, head: int = HEAD, filter_bytes: int = FILTER_BYTES, bits_each: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; fold 1 is held out.

    `head` and `filter_bytes` bound what workers hold and change no result. `bits_each` are the filter's bits for an
    entry: with 8, one probe in 40 hits falsely; with 64, one in 80,000."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", fold() == 1)
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model, owned = train(plain.where(~F.col("held_out")), size, head, filter_bytes, bits_each)
    total, n = model.total, model.tokens
    shared = spark.sparkContext.broadcast(model)
    if model.filter is not None:
        rows = plain.mapInArrow(_score(shared), SCORED_KINDS)
    else:
        asked = materialize(plain.mapInArrow(_ask(model.bits), ASKED), "lm-asked")
        answers = asked.where("bucket is not null").select("fid", "bucket", "gaps").groupBy("bucket").applyInArrow(_answer(model.folder), "fid long, bucket long, levels binary")
        texts = asked.where("bucket is null").select("fid", "doc_id", "held_out", "text")
        rows = texts.groupBy("fid").cogroup(answers.groupBy("fid")).applyInArrow(_score_answered(shared), SCORED_KINDS)
    scored = materialize(rows, "lm-scored")
    asks = scored.where("bucket is not null").select("bucket", "fid", "rows", "gaps")
    have = owned.select("bucket", F.lit(None).cast("long").alias("fid"), F.col("counts").alias("rows"), "gaps")
    found = asks.unionByName(have).groupBy("bucket").applyInArrow(_look_up(total), "fid long, rows binary, counts binary")
    tail = found.groupBy("fid").applyInArrow(_sum_up(total), "fid long, local int, tail_score double, tail_known long")
    rows = scored.where("bucket is null").join(tail, ["fid", "local"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("tail_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("head_score") + zero("tail_score")).alias("base_score"), "score")
