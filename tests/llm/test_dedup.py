"""Exact, substring and near deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import WORD, rows_of


def exact(rows):
    norm = [(k, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for k, t in rows]
    groups = defaultdict(list)
    for k, t in norm:
        groups[t].append(k)
    low = {t: min((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    return Counter((k, low[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in norm), len(groups)


@pytest.mark.parametrize("key_bits,capacity", [(64, 4096), (64, 3), (3, 4)])
def test_exact(spark, documents, odd, key_bits, capacity):
    from llm.exact_dedup import exact_dedup

    for df in (documents, odd):
        got = exact_dedup(df, capacity, key_bits).collect()
        want, groups = exact(rows_of(df))
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == groups
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_directory_doubles_until_no_bucket_is_overfull():
    from llm.exact_dedup import split

    fit, over = split({0: 5, 1: 1, 2: 1, 7: 2}, 3, 4)
    assert over == [(3, 0)]
    assert sorted(p << (3 - d) for d, p in fit) == [1, 2, 4]


def covered(rows, size=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = Counter()
    for (k, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring(spark, documents, odd):
    from llm.substring_dedup import substring_dedup

    base = [f"v{i}" for i in range(200)]
    planted = spark.createDataFrame(
        [(1, " ".join(base)), (2, "x y " + " ".join(base[50:120]) + " z"), (3, " ".join(base[90:140])), (4, " ".join(base[:34])), (5, " ".join(["a", "b"] * 40)), (6, " ".join(base[100:135]) + " q " + " ".join(base[100:135]))],
        "doc_id long, text string",
    )
    for df in (planted, odd, documents):
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(df).collect())
        assert got == covered(rows_of(df))


def linked(rows):
    sets = {}
    for k, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in sets if k is not None}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(up)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                a1, b1 = sorted((root(a), root(b)))
                up[b1] = a1
    return Counter((k, len(sets[k]), None if k is None else root(k)) for k, _ in rows)


def test_near(spark, documents, odd):
    from llm.near_dedup import near_dedup

    base = [f"v{i}" for i in range(120)]
    family = [(i, " ".join(base[: 3 * i] + [f"n{i}"] + base[3 * i + 1 :])) for i in range(30)] + [(100 + i, " ".join(base[: 60 + 6 * i])) for i in range(10)]
    for df in (spark.createDataFrame(family, "doc_id long, text string"), odd, documents):
        got = near_dedup(df).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == linked(rows_of(df))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_families_of_many_blocks(spark, monkeypatch):
    """Copies of one text at all distances from it, far more than a block holds: no link between blocks is lost."""
    import random

    from llm import near_dedup

    rng, base = random.Random(8), [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(f"r{rng.randrange(40)}" if rng.random() < (i % 12) / 50 else x for x in base)) for i in range(150)]
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1500)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = linked(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert 10 < len({c for _, _, c in want}) < 140


def test_near_repeated_ids_are_one_node(spark):
    from llm.near_dedup import near_dedup

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (6, a + " end"), (6, b), (9, b), (9, b), (10, "start " + b), (11, c)]
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (6, 5), (9, 5), (10, 5), (11, 11)}


def test_components_that_do_not_settle_are_an_error(spark):
    from llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r["component"] for r in components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, 1)


def test_empty(empty):
    from llm.exact_dedup import exact_dedup
    from llm.near_dedup import near_dedup
    from llm.substring_dedup import substring_dedup

    assert [f(empty).count() for f in (exact_dedup, near_dedup, substring_dedup)] == [0, 0, 0]


def test_copies_without_end_are_flushed():
    """A million copies of one text stay within 64 MB in a task and give entries of bounded size."""
    import tracemalloc

    import pyarrow as pa

    from llm.exact_dedup import FLUSH_BYTES, ID_BYTES, entries_of

    def batches():
        for i in range(0, 1_000_000, 1000):
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + 1000), pa.int64()), pa.array(["one text"] * 1000)], names=["doc_id", "text"])

    tracemalloc.start()
    sizes, seen = [], 0
    for out in entries_of(64)(batches()):
        for n, low in zip(out["ids"].value_lengths().to_pylist(), out["min_id"].to_pylist()):
            assert low == seen
            sizes.append(n)
            seen += n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 1_000_000 and max(sizes) <= FLUSH_BYTES // ID_BYTES + 1000 and peak < 64 << 20
