"""Connected components of an edge table by alternating large-star and small-star rounds; all state stays distributed.

Defined results: rows that repeat an edge, its reverse and loops change nothing; an empty table gives no nodes; edges
with a null end are left out; if the rounds have not settled after ROUNDS (they take some log2(n)**2 at worst) an error
is raised. Texts and other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from llm.shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node around u: those above u (large star), or u and those below it (small star)."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


ROUNDS = 400


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, component (the least node it reaches) for each node that has an edge; edges are (u, v) pairs of longs."""
    at = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    for _ in range(rounds):
        at = materialize(_star(_star(at, True), False), "components")
        # settled when every node hangs on one root that hangs on nothing
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = at.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return at.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots.join(at.select(F.col("u").alias("node")), "node", "left_anti"))
