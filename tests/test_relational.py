"""Streamed batches and nearest vectors against plain loops."""

import random

import numpy as np
import pytest

from claimforge.operators import relational as X


def plain_batches(rows, limit):
    out, last, n, batch = [], object(), 0, 0
    for key, pos, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if key != last:
            last, n, batch = key, 0, 0
        elif n and n + (size or 0) > limit:
            n, batch = 0, batch + 1
        n += size or 0
        out.append((key, pos, batch))
    return out


def test_batches_stream_over_arrow_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", "c", None]), i, rng.choice([None, 0, 1, 3, 7, 60])) for i in range(3000)]  # one key with two fifths of all rows
    df = spark.createDataFrame(rows, "k string, pos int, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = X.greedy_batches(df, ["k"], ["pos"], "n", 45).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r["k"], r["pos"], r["batch"]) for r in got), key=str) == sorted(plain_batches(rows, 45), key=str)
    plan = X.greedy_batches(df, ["k"], ["pos"], "n", 45)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1
    assert X.greedy_batches(df.limit(0), ["k"], ["pos"], "n", 45).count() == 0


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_vectors_with_ties(spark, monkeypatch, k):
    monkeypatch.setattr(X, "TILE", 7)
    rng = np.random.default_rng(2)
    e = rng.integers(-2, 3, (90, 3)).astype(float)  # many equal directions
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>")
    got = X.top_by_cosine(df, df.where("vec_id % 5 = 0"), k).collect()
    have = [i for i in range(90) if e[i].any()]
    unit = {i: e[i] / np.sqrt((e[i] ** 2).sum()) for i in have}
    for q in (i for i in have if i % 5 == 0):
        score = {i: round(float(unit[q] @ unit[i]), 9) for i in have if i != q}
        mine = sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in got if r["query_id"] == q)
        assert [s for _, _, s in mine] == sorted(score.values(), reverse=True)[:k]
        assert all(score[i] == s for _, i, s in mine)


@pytest.mark.parametrize("both_ways", [False, True])
def test_reach_is_a_breadth_first_search(spark, both_ways):
    from claimforge.operators.projection import reach

    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)] + [("n1", None), ("n0", "n0")]
    beside = {}
    for a, b in pairs:
        if b is not None:
            beside.setdefault(a, set()).add(b)
            if both_ways:
                beside.setdefault(b, set()).add(a)
    want = set()
    for start in ("n0", "n7", "lone"):
        seen, front = {start: 0}, [start]
        for depth in (1, 2, 3):
            front = sorted({b for a in front for b in beside.get(a, ()) if b not in seen})
            seen |= dict.fromkeys(front, depth)
        want |= {(start, k, d) for k, d in seen.items()}
    edges, starts = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("n0",), ("n7",), ("n7",), ("lone",)], "node string")
    got = [tuple(r) for r in reach(edges, starts, 3, both_ways).collect()]
    assert len(got) == len(set(got)) and set(got) == want
