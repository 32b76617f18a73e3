"""Near-duplicate groups by min-max hashing with banding, confirmed on full shingle sets.

Each of PERMS permutations gives two signature values, its least and its greatest image of the set, so half as many
hash evaluations serve a signature; two permutations (four values) make a band. Documents with equal sets fold into
one representative first. In each bucket of a band the member that shares the most buckets is the centre; all members
of the buckets of one centre are its family, and every two documents that share a bucket are in a family together.

A family's sets travel once. A task that has them counts how many shingles one member shares with all the others,
the centre first and then whoever is not in the largest group, and gives a link wherever it joins two groups that
were apart: at most one link for each member, and no pair ever leaves a task unconfirmed. A family of more than
BLOCK_SHINGLES shingles comes in blocks, each with the centre; what these leave apart is compared block by block, only
the members outside the family's largest group against all.

A pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**40, under 3e-7 (up to 1e-5 for sets of a few
shingles). Shingles are told apart by 64-bit hashes, whole sets by 128 bits.

Defined results: null or blank texts have an empty set and no links; a text of fewer words than a shingle is one
shingle; very long texts count whole; sets of equal similarity are linked in any order, which no result depends on;
rows that repeat a doc_id count as one node, with the sets of all of them, and all get its group, all kept or all not;
a null doc_id is a node of its own that is never linked, with a null component; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.components import components
from llm.kernel import Spans, U, Words, mix, release, slices, sort_unique
from llm.shared import bounded, materialize

WORDS, PERCENT, PERMS, SEED = 5, 75, 80, 20240601
BLOCK_SHINGLES, SHIP_BYTES = 1 << 20, 2 << 20


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row as 64-bit hashes, ascending: (hashes, first index of each row and the end)."""
    w = Words(column, lower=True)
    spans, per = Spans(w.hashes()), np.diff(w.first)
    take = np.where(per >= words, per - words + 1, np.minimum(per, 1))
    ends = np.cumsum(take)
    row = np.repeat(np.arange(w.rows), take)
    at = np.repeat(w.first[:-1], take) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - take, take)
    return sort_unique(row, spans.of(at, np.minimum(at + words, w.first[1:][row])), w.rows)


def signature(sets: np.ndarray, first: np.ndarray, perms: int = PERMS) -> np.ndarray:
    """rows x 2*perms unsigned 32-bit values: for each permutation the least and the greatest image."""
    rows = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, 2 * perms), np.uint32)
    if not len(rows):
        return out
    begin, x = first[:-1][rows], (sets >> U(32)).astype(np.uint32)
    keys = mix(np.arange(2 * perms, dtype=U) + U(SEED)).astype(np.uint32)
    for k in range(perms):
        y = (x ^ keys[2 * k]) * (keys[2 * k + 1] | np.uint32(1))
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[rows, 2 * k] = np.minimum.reduceat(y, begin)
        out[rows, 2 * k + 1] = np.maximum.reduceat(y, begin)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """rows x perms/2 keys: each hashes four signature values and the band's number."""
    n = sig.shape[1] // 4
    parts = sig.reshape(len(sig), n, 4).astype(U)
    return mix(mix(parts[:, :, 0] << U(32) | parts[:, :, 1]) ^ (parts[:, :, 2] << U(32) | parts[:, :, 3]) * U(0x9E3779B97F4A7C15) + np.arange(n, dtype=U))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets, first = shingles(part["text"])
        digest = [np.add.reduceat(np.r_[mix(sets ^ U(s)), U(0)], first[:-1]) * (np.diff(first) > 0) if len(first) > 1 else np.zeros(0, U) for s in (1, 2)]
        keys = bands(signature(sets, first)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [part["doc_id"], pa.array(np.diff(first)), *(pa.array(d.astype(U).view(np.int64)) for d in digest), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())],
            names=["doc_id", "n_shingles", "s1", "s2", "bands"],
        )


def links(reps: np.ndarray, group: np.ndarray, asks: np.ndarray, first: np.ndarray, values: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links that join groups of a block: each asking member, the first one foremost, is held against all members.

    Where all ask, those in the largest group after the first need not: the others have been held against them."""
    m, n = len(reps), np.diff(first)
    if m == 2:
        both = len(np.intersect1d(values[: n[0]], values[n[0] :], assume_unique=True))
        if reps[0] != reps[1] and 100 * both >= percent * (n[0] + n[1] - both):
            yield int(reps.min()), int(reps.max())
        return
    root = np.unique(group, return_inverse=True)[1]
    element = np.unique(values, return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    holders = np.repeat(np.arange(m), n)[order]
    begin = np.searchsorted(element[order], np.arange(element.max(initial=-1) + 2))
    count = np.diff(begin)
    big = None
    for step, r in enumerate(np.flatnonzero(asks)):
        if step and (root == root[0]).all():
            return
        if step == 1 and asks.all():
            big = int(np.flatnonzero(root == np.bincount(root).argmax())[0])
        if big is not None and root[r] == root[big]:
            continue
        e = element[first[r] : first[r + 1]]
        each = count[e]
        ends = np.cumsum(each)
        both = np.bincount(holders[np.repeat(begin[e] - (ends - each), each) + np.arange(ends[-1])], minlength=m)
        near = np.flatnonzero((100 * both >= percent * (n[r] + n - both)) & (root != root[r]))
        for j in near[np.unique(root[near], return_index=True)[1]]:
            yield int(min(reps[r], reps[j])), int(max(reps[r], reps[j]))
            root[root == root[j]] = root[r]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive sorted; one that goes on in the next batch is held back."""

    def done(rows: pa.Table) -> Iterator[tuple[int, int]]:
        keys = [rows[c].to_numpy() for c in ("c", "a", "b")]
        cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        for i, j in zip([0, *cuts], [*cuts, rows.num_rows]):
            if j - i < 2:
                continue
            block = rows.slice(i, j - i)
            rep, sets = block["rep"].to_numpy(), block["set"].to_pylist()
            # the centre first; a set that came more than once counts once, and asks if it does so in any of its places
            once = {(int(rep[k]), sets[k]): k for k in np.argsort(rep == keys[0][i], kind="stable")[::-1].tolist()}
            order = list(once.values())[::-1]
            asking = {int(r) for r, a in zip(rep, block["ask"].to_pylist()) if a}
            ask = np.array([int(r) in asking for r in rep])
            raw = [np.frombuffer(sets[k], U) for k in order]
            yield from links(rep[order], block["group"].to_numpy()[order], ask[order], np.concatenate([[0], np.cumsum([len(x) for x in raw])]), np.concatenate(raw))

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[c].to_numpy() for c in ("c", "a", "b")]
        end = tuple(int(c[-1]) for c in cols)
        cut = int(np.flatnonzero(np.any([c != x for c, x in zip(cols, end)], axis=0)).max(initial=-1)) + 1
        if held and (cut or last != end):
            held.append(batch.slice(0, cut))
            yield out(list(done(pa.Table.from_batches(held))))
            held = [batch.slice(cut)]
        elif cut:
            yield out(list(done(pa.Table.from_batches([batch.slice(0, cut)]))))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = end
    if held:
        yield out(list(done(pa.Table.from_batches(held))))
    release()


def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's set for each of its places; a set that a task has met under one id already isn't sent again."""
    sent: set[tuple[int, int]] = set()
    for part in slices(batches):
        sets, first = shingles(part["text"])
        ids, places = part["doc_id"].to_pylist(), part["places"].to_pylist()
        rows, size = [], 0
        for r, (k, where) in enumerate(zip(ids, places)):
            raw = sets[first[r] : first[r + 1]].tobytes()
            if not raw or (k, hash(raw)) in sent:
                continue
            sent.add((k, hash(raw)))
            for p in where:
                rows.append((p["c"], p["a"], p["b"], k, p["group"], p["ask"], raw))
                size += len(raw) + 48
                if size > SHIP_BYTES:
                    yield _shipped(rows)
                    rows, size = [], 0
        if rows:
            yield _shipped(rows)


def _shipped(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["c", "a", "b", "rep", "group", "ask", "set"])


def compare(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Links (u, v) found in the blocks (c, a, b) that `places` (rep, c, a, b, group, ask) deals the documents' sets to."""
    to = places.groupBy("rep").agg(F.collect_list(F.struct("c", "a", "b", "group", "ask")).alias("places"))
    joined = docs.join(bounded(to, F.size("places") * 40 + 48), F.col("doc_id") == F.col("rep")).select("doc_id", "text", "places")
    sent = joined.mapInArrow(_ship, "c long, a int, b int, rep long, group long, ask boolean, set binary")
    return sent.repartition("c", "a", "b").sortWithinPartitions("c", "a", "b").mapInArrow(_link, "u long, v long")


def across(family: DataFrame, label: DataFrame) -> DataFrame:
    """Places of what the blocks of large families leave apart: members outside the family's largest group ask all members."""
    named = family.where("sides > 1").select("c", "rep", "n", "sides").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.withColumn("group", F.coalesce("component", "rep")).drop("component"), "near-families")
    top = named.groupBy("c", "group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    top = top.groupBy("c").agg(F.max_by("group", F.struct("m", F.negative("group"))).alias("top"), F.sum("n").alias("all"), F.max_by("n", F.struct("m", F.negative("group"))).alias("joined"))
    at = named.join(top, "c").withColumn("asking", F.ceil((F.col("all") - F.col("joined")) / BLOCK_SHINGLES).cast("int")).where("asking > 0")
    side = lambda salt, count: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(count)).cast("int")
    common = ["rep", "c", "group"]
    target = at.select(*common, F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("a"), side(1, "sides").alias("b"), F.lit(False).alias("ask"))
    asks = at.where("group <> top").select(*common, side(2, "asking").alias("a"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("b"), F.lit(True).alias("ask"))
    return target.unionByName(asks)


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(plain.mapInArrow(_sign, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "near-signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")), "near-sets")
    keyed = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    member = materialize(keyed.join(shared, "key"), "near-buckets")
    weighed = member.join(member.groupBy("rep").agg(F.sum("members").alias("weight")), "rep")
    centre = weighed.groupBy("key").agg(F.max_by("rep", F.struct("weight", F.negative("rep"))).alias("c"))
    family = member.join(centre, "key").groupBy("c", "rep").agg(F.max("n").alias("n"))
    size = family.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    # sets differ by a quarter at most in size if they meet the threshold: two that differ by more need no comparison
    size = size.where((F.col("m") > 2) | (F.lit(100) * F.col("lo") >= F.lit(PERCENT) * F.col("hi"))).where("m > 1")
    family = materialize(family.join(size.select("c", F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("sides")), "c"), "near-families")
    # the centre is in each block of its family
    block = F.when(F.col("rep") == F.col("c"), F.sequence(F.lit(0), F.col("sides") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int")))
    places = family.select("rep", "c", F.explode(block).alias("a"), F.lit(-1).alias("b"), F.col("rep").alias("group"), F.lit(True).alias("ask"))
    found = materialize(compare(plain, places).unionByName(same_id(usable, reps)), "near-links")
    label = components(found)
    if family.where("sides > 1").limit(1).count():
        label = components(found.unionByName(materialize(compare(plain, across(family, label)), "near-links")))
    home = reps.select("s1", "s2", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(home, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def same_id(usable: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the sets that rows of one doc_id have."""
    both = usable.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).where("lo <> hi").select("doc_id")
    sets = usable.join(both, "doc_id").select("doc_id", "s1", "s2").distinct().join(reps.select("s1", "s2", "rep"), ["s1", "s2"])
    low = sets.groupBy("doc_id").agg(F.min("rep").alias("u"))
    return sets.join(low, "doc_id").where("u < rep").select("u", F.col("rep").alias("v"))
