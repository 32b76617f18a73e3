"""The similarity join held against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from claimforge.operators import similarity as S


def ratio(a, b):
    return SequenceMatcher(None, a or "", b or "").ratio()


def plain(left, right, least, same):
    pairs = []
    for g, i, a in left:
        for h, j, b in left if same else right:
            if g is not None and g == h and (not same or i < j) and ratio(a, b) >= least:
                pairs.append((i, j))
    if same:
        seen = [x for p in pairs for x in p]
        return sorted(p for p in pairs if seen.count(p[0]) == seen.count(p[1]) == 1)
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    return sorted(p for p in pairs if a.count(p[0]) == b.count(p[1]) == 1)


def texts(rng, n):
    """Short, long, repeating and Chinese texts, near and equal copies, nulls."""
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            base = list(rng.choice(out) or "")
            for _ in range(rng.randrange(3)):
                if base and rng.random() < 0.5:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.insert(rng.randrange(len(base) + 1), rng.choice("abc药险"))
            out.append("".join(base))
        elif kind < 0.6:
            out.append(rng.choice([None, "", "a", "b", "aa", "aaaaaaaaaaaa", "abababababab", "药", "药享", "é"]))
        else:
            out.append("".join(rng.choice("abcdefgh 药享保险🙂") for _ in range(rng.choice([2, 3, 5, 9, 14, 15, 20, 22, 40]))))
    return out


@pytest.mark.parametrize("least", [0.85, 0.75, 0.6])
def test_equals_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    rows = lambda k, n: [(rng.choice(["x", "x", "y", None]), k + i, t) for i, t in enumerate(texts(rng, n))]
    left, right = rows(0, 140), rows(1000, 140)
    frames = [spark.createDataFrame(x, f"g string, {n} long, t string") for x, n in ((left, "a"), (right, "b"))]
    got = sorted((r["a"], r["b"]) for r in S.fuzzy_unique(*frames, ["g"], "a", "b", "t", least).collect())
    assert got == plain(left, right, least, False) != []
    twice = [f.withColumnRenamed(f.columns[1], n) for f, n in ((frames[0], "a"), (frames[0], "b"))]
    got = sorted((r["a"], r["b"]) for r in S.fuzzy_unique(*twice, ["g"], "a", "b", "t", least, same=True).collect())
    assert got == plain(left, None, least, True) != []


def test_bounds_hold_and_exclude(spark):
    """Every pair at the threshold is a candidate, and no candidate is one that the bounds exclude."""
    rng = random.Random(11)
    found = [t or "" for t in texts(rng, 300)]
    rows = [("x", i, 0, t, len(t), 1, i, False) for i, t in enumerate(sorted(set(found)))]
    nodes = spark.createDataFrame(rows, "g string, node long, side int, text string, chars int, n long, first long, full boolean")
    got = S.candidate_pairs(nodes, ["g"], 0.85, True).collect()
    at = {r[1]: r[3] for r in rows}
    pairs = {(r["l"], r["r"]) for r in got}
    assert {(i, j) for i in at for j in at if i < j and ratio(at[i], at[j]) >= 0.85} <= pairs
    assert len(pairs) == len(got) < len(at) ** 2 / 20
    for i, j in pairs:
        a, b = at[i], at[j]
        hit = -(-(len(a) + len(b)) * 85 // 200)
        assert 2 * min(len(a), len(b)) >= 0.85 * (len(a) + len(b)) - 1e-9
        two = lambda t: {t[k : k + 2] for k in range(len(t) - 1)}
        assert len(two(a) & two(b)) >= len(two(a)) - 2 * (len(a) - hit) - (len(b) - hit)


def test_a_mass_of_like_texts_makes_no_pairs(spark):
    """Two thousand texts that are all alike have partners enough after the first pass; a lone pair is still found."""
    rows = [("x", i, f"policy holder number {i:05d} of the company") for i in range(2000)]
    rows += [("x", 9001, "quite another subject altogether"), ("x", 9002, "quite another subject altogethr")]
    df = spark.createDataFrame(rows, "g string, id long, t string")
    nodes = df.select("g", F.col("id").alias("node"), F.lit(0).alias("side"), F.col("t").alias("text"), F.char_length("t").alias("chars"), F.lit(1).cast("long").alias("n"), F.col("id").alias("first"))
    full = nodes.join(S.crowded(nodes, ["g"], 0.85, True), "node", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    assert full.where("full").count() >= 1990
    assert S.candidate_pairs(full, ["g"], 0.85, True).count() < 40_000
    left, right = df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b")
    assert [(r["a"], r["b"]) for r in S.fuzzy_unique(left, right, ["g"], "a", "b", "t", 0.85, same=True).collect()] == [(9001, 9002)]


def test_empty(spark):
    none = spark.createDataFrame([], "g string, a long, t string")
    assert S.fuzzy_unique(none, none.withColumnRenamed("a", "b"), ["g"], "a", "b", "t", 0.85).count() == 0
