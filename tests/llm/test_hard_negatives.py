"""Hard negatives held against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.hard_negatives import BallTree, Search, hard_negatives

SHAPE = "vec_id long, embedding array<double>, label int, anchor_id string"


def plain(rows, step=3, scale=256, k=5, band=(80, 100)):
    seen = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen[i] = min(seen.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in seen.items()}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a][1], whole[b][1]))
    out = []
    for a in (i for i in whole if i % step == 0):
        near = sorted(((-score(a, b), b) for b in whole if b != a and whole[b][0] == whole[a][0]))[:k]
        for s, p in near:
            far = sorted((-score(a, b), b) for b in whole if whole[b][0] != whole[a][0] and band[0] * -s <= 100 * score(a, b) <= band[1] * -s)[:k]
            out += [(a, p, r + 1, b, -s, -t) for r, (t, b) in enumerate(far)]
    return sorted(out)


def mined(df, step=3, **more):
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % step == 0, **more).collect())


@pytest.fixture
def small_trees(monkeypatch):
    monkeypatch.setattr("llm.hard_negatives.TREE_ROWS", 90)
    monkeypatch.setattr("llm.hard_negatives.LEAF_ROWS", 8)


def test_equals_plain(spark, small_trees):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.2 * rng.normal(size=8)], int(rng.integers(0, 4)), "x") for i in range(500)]
    rows += [(500 + i, rows[0][1], i % 2, "x") for i in range(200)]  # one vector many times: ties
    df = spark.createDataFrame(rows, SHAPE)
    assert mined(df) == plain(rows) != []
    assert mined(df, band=(50, 90)) == plain(rows, band=(50, 90)) != []
    assert mined(df, positives=3, negatives=3) == plain(rows, k=3)


def test_many_blocks(spark, small_trees, monkeypatch):
    monkeypatch.setattr("llm.hard_negatives.QUERY_BYTES", 8 * 4 * 20)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3, "x") for i in range(240)]
    assert mined(spark.createDataFrame(rows, SHAPE)) == plain(rows)


def test_odd_rows(spark, small_trees):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1, "x"), (3, [1.0, 2.0], 1, "x"), (None, [1.0, 1.0], 1, "x"), (4, None, 1, "x"), (5, [1.0, None], 1, "x"), (6, [nan, 1.0], 2, "x"), (7, [inf, 1.0], 2, "x"), (8, [1.0, 1.9], None, None)]
    rows += [(9, [1.0, 1.9], 2, "x"), (9, [1.0, 1.9], 2, "x"), (10, [1.0, 1.8, 0.5], 2, "x"), (11, [1.0], 2, "x"), (12, [], 2, "x"), (15, [-1.0, -2.0], 1, "x"), (16, [0.9, 2.0], 3, "x"), (9, [5.0, 5.0], 4, "x")]
    assert mined(spark.createDataFrame(rows, SHAPE)) == plain(rows) != []
    assert mined(spark.createDataFrame([], SHAPE)) == []
    lone = [(0, [1.0], 1, "x"), (1, [1.0], 2, "x")]  # an anchor without positives
    assert mined(spark.createDataFrame(lone, SHAPE)) == []


def test_great_values_are_exact(spark):
    rows = [(i, [float(2**21 + i), float(3**12 - i)], i % 2, "x") for i in range(40)]
    assert mined(spark.createDataFrame(rows, SHAPE)) == plain(rows) != []
    with pytest.raises(Exception, match="63 bits"):
        mined(spark.createDataFrame([(i, [1e30 + i], i % 2, "x") for i in range(9)], SHAPE))


def test_nodes_are_pruned():
    rng = np.random.default_rng(7)
    x = np.floor(256 * np.repeat(rng.normal(size=(32, 16)), 128, 0) + rng.normal(size=(4096, 16)))
    t = BallTree.build(np.arange(4096), np.zeros(4096, np.int64), x)
    same = BallTree.read(dict(zip(("ids", "labels", "vectors", "nodes", "centres", "bounds", "dim"), t.row())))
    assert (same.x == t.x).all() and (same.radius == t.radius).all() and (same.ranges == t.ranges).all()
    s = Search(np.array([-1]), np.array([0]), x[:1], np.array([0]), np.array([-(2**62)]), np.array([2**62]), np.array([0]), True, 5)
    seen, leaf = [], s.leaf
    s.leaf = lambda t, q, b, e, a: (seen.append(e - b), leaf(t, q, b, e, a))
    s.over(same)
    order = np.lexsort((t.ids, -(t.x @ x[0])))[:5]
    assert s.found[0].tolist() == t.ids[order].tolist() and sum(seen) < 1024


def test_query_on_the_table(spark):
    import duckdb

    from llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_hard_negatives"](spark, sf)
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(ORACLES["op13_hard_negatives"])
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
