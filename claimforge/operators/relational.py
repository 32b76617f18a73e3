"""Relational operators that the engine is built from, each a composition of Spark's own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimforge.operators.similarity import fuzzy_unique  # noqa: F401  (part of this module's interface)
from claimforge.scratch import settle


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with `repeated`: true for rows after the first of their key. A key counts even if its row fails elsewhere."""
    return df.withColumn("repeated", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def latest(df: DataFrame, key: str, order: str, tie: str, n: int) -> DataFrame:
    """The n latest rows of each key. Rows come back unordered; callers sort ascending for display."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(tie).desc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fill_down(df: DataFrame, key: str, order: str, label: str, out: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(label, ignorenulls=True).over(w))


def live(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return df.where(F.col(expires) > now)


def members(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among the wanted ones; an empty set gives an empty result."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def unique_slots(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of slots that hold exactly one row on each side. Counting first keeps hot slots out of the join."""
    one = lambda df, i: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(i).alias(i)).where("n = 1").drop("n")
    return one(left, left_id).join(one(right, right_id), keys).select(left_id, right_id)


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, array: str, on: list[str] | None = None) -> DataFrame:
    """Distinct (left_id, right_id) whose arrays share an element, through an equi-join on elements."""
    keys = [*(on or []), "element"]
    a = left.select(left_id, *(on or []), F.explode(F.array_distinct(array)).alias("element"))
    b = right.select(right_id, *(on or []), F.explode(F.array_distinct(array)).alias("element"))
    return a.join(b, keys).select(left_id, right_id).distinct()


def path_prefixes(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Pairs within a key of which one path equals or contains the other, through the ancestors of both."""
    ups = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, r"\."))), lambda n: F.array_join(F.slice(F.split(p, r"\."), F.lit(1), n), "."))
    x, y = left.select(key, a).distinct(), right.select(key, b).distinct()
    down = x.withColumn("hit", F.explode(ups(F.col(a)))).join(y.withColumn("hit", F.col(b)), [key, "hit"])
    up = y.withColumn("hit", F.explode(ups(F.col(b)))).join(x.withColumn("hit", F.col(a)), [key, "hit"])
    return down.select(key, a, b).unionByName(up.select(key, a, b)).distinct()


def priority_rollup(dims: DataFrame, facts: DataFrame, key: str, status: str, ranking: list[str], default: str) -> DataFrame:
    """For each dimension key the strongest status that its facts have, the default without facts."""
    ranks = F.create_map(*[x for i, s in enumerate(reversed(ranking)) for x in (F.lit(s), F.lit(i + 1))])
    best = facts.groupBy(key).agg(F.max(F.element_at(ranks, F.col(status))).alias("r"))
    names = F.array(*[F.lit(s) for s in [default, *reversed(ranking)]])
    return dims.select(key).distinct().join(best, key, "left").select(key, F.element_at(names, F.coalesce("r", F.lit(0)) + 1).alias(status))


def batches(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """`df` with `batch`: runs of `size` rows of a key, from 0."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))


def greedy_batches(df: DataFrame, key: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """`df` with `batch` (from 0 in each key): rows of a key in order, of which one starts a batch if it would overfill the last.

    Rows stream through sorted partitions and only the open batch's size is carried on, across Arrow batches too: a key of
    any length takes constant memory. A null size counts as 0; a null is a key like others."""
    schema = df.select("*", F.lit(0).alias("batch")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, filled, number = None, 0, 0
        for part in batches:
            out = np.empty(part.num_rows, np.int32)
            keys = zip(*(part[k].to_pylist() for k in key))
            for i, (own, n) in enumerate(zip(keys, pc.fill_null(part[size], 0).to_pylist())):
                if own != last:
                    last, filled, number = own, 0, 0
                elif filled and filled + n > limit:
                    filled, number = 0, number + 1
                filled += n
                out[i] = number
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names=[*part.schema.names, "batch"])

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


#: Queries and vectors of one matrix product of the nearest-vector search: 8 MB of scores.
TILE = 1024


def top_by_cosine(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k nearest vectors of each query row by exact cosine, ties to the lesser id; a vector isn't its own neighbour.

    Queries go out in blocks of about `block` rows, each against all vectors: a task multiplies its vectors with a block and
    sends on its k best for each query, so what moves is k rows for each query and task. Without queries or with zero
    vectors there are no scores: the latter are left out."""
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)))
    plain = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.exists("e", lambda x: x != 0)).select("vec_id", unit(F.col("e")).alias("e"))
    asked = settle(plain(queries))
    blocks, out = -(-asked.count() // block), None
    for b in range(blocks):
        # by hash, so some `block` rows
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
        if not len(rows):
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((rows["vec_id"].to_numpy(), np.array(rows["e"].tolist())))
        part = plain(vectors).mapInPandas(_best(shared, k), "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best_id, best = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)
        for batch in batches:
            every, new = (np.array(batch["e"].tolist()), batch["vec_id"].to_numpy()) if len(batch) else ((), ())
            for j in range(0, len(new), TILE):
                x, own = every[j : j + TILE], new[j : j + TILE]
                for i in range(0, len(ids), TILE):
                    score = q[i : i + TILE] @ x.T
                    score[ids[i : i + TILE, None] == own[None, :]] = -np.inf
                    # only rows of which a vector reaches the k-th so far; of these only what reaches their own k-th of the tile
                    hit = np.flatnonzero((score >= best[i : i + TILE, -1:]).any(1))
                    if not len(hit):
                        continue
                    score = score[hit]
                    if score.shape[1] > k:
                        score[score < np.partition(score, -k, axis=1)[:, -k, None]] = -np.inf
                    width = max(k, int((score > -np.inf).sum(1).max()))  # more than k where the k-th is tied
                    at = np.argsort(-score, axis=1, kind="stable")[:, :width] if score.shape[1] > width else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                    both = np.hstack([best[i + hit], np.take_along_axis(score, at, 1)])
                    who = np.hstack([best_id[i + hit], own[at]])
                    order = np.lexsort((who, -both), axis=1)[:, :k]
                    best[i + hit], best_id[i + hit] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
        row, col = np.nonzero(best > -np.inf)
        yield pd.DataFrame({"query_id": ids[row], "vec_id": best_id[row, col], "score": best[row, col]})

    return run
