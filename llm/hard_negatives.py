"""Hard-negative mining: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels
whose score lies in a band under the positive's.

Every partition holds its vectors as ball trees of some thousand rows. A node bounds the inner products of an anchor with
all its rows from both sides, centre . q +- radius |q|; it is left out where all of it lies outside the band, strictly
beneath the anchor's current k-th, or under labels that can't count. Anchors go down a tree together, and their k-th
carries over from tree to tree of a task, so a task gives k rows an anchor however many trees it has read.

Anchors are the stated query set; they go out in blocks of QUERY_BYTES at most (counted), each against all trees.
A block's positives (k rows an anchor) come back to the driver to form the bands, nothing else does.

Defined results: rows with a null id, label, vector or component, or with a component that is not finite, take no part; of
rows that repeat an id the one with the least label, then least vector, counts; of vectors of different lengths the
shorter counts as filled up with zeros, and an empty one scores 0 with all; ties go to the smaller id; an anchor without
positives or without rows in a band gives no rows, an empty table an empty one; texts play no part, nor do other columns,
of any name. Vectors whose lengths multiply
to more than 63 bits raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from llm.kernel import release
from llm.shared import materialize, scratch

TREE_ROWS, LEAF_ROWS = 4096, 64
QUERY_BYTES = 4 << 20
POSITIVES = NEGATIVES = 5
BAND = (80, 100)
LOW, HIGH = -(2**63 - 1), 2**63 - 1
EXACT = 2.0**53
TREE = "ids binary, labels binary, vectors binary, nodes binary, centres binary, bounds binary, dim int"


def usable(rows: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """id, label, v (doubles) of the rows that take part, one row for each id. Rows that repeat an id are folded before the shuffle."""
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    plain = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), v.alias("v"), fine.alias("fine"))
    return plain.where("id is not null and label is not null and v is not null and fine").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x), rows filled up with zeros to the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    dim = int(size.max(initial=0))
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


class BallTree:
    """Rows in leaf order; nodes (begin, end, left, right), centres, and bounds (radius, least and greatest label, least id)."""

    def __init__(self, ids, labels, x, nodes, centres, radius, ranges):
        self.ids, self.labels, self.x, self.nodes, self.centres, self.radius, self.ranges = ids, labels, x, nodes, centres, radius, ranges
        self.most = float(np.abs(x).max(initial=0.0))

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> "BallTree":
        order, nodes, centres, radius = np.arange(len(ids)), [], [], []

        def grow(begin: int, end: int) -> int:
            own = x[order[begin:end]]
            centre = own.mean(0)
            away = ((own - centre) ** 2).sum(1)
            at = len(nodes)
            nodes.append([begin, end, -1, -1])
            centres.append(centre)
            radius.append(float(np.sqrt(away.max(initial=0.0))))
            if end - begin > LEAF_ROWS:
                one = own[int(away.argmax())]
                other = own[int(((own - one) ** 2).sum(1).argmax())]
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own @ (one - other), middle)]
                nodes[at][2:] = grow(begin, begin + middle), grow(begin + middle, end)
            return at

        grow(0, len(ids))
        ids, labels, x = ids[order], labels[order], x[order]
        ranges = np.array([[labels[b:e].min(), labels[b:e].max(), ids[b:e].min()] for b, e, _, _ in nodes], np.int64)
        return BallTree(ids, labels, x, np.array(nodes, np.int64), np.array(centres), np.array(radius), ranges)

    def row(self) -> tuple:
        small = self.most < 2**31
        packed = self.x.astype("<i4" if small else "<f8").tobytes()
        bounds = np.column_stack([self.radius.view(np.int64), self.ranges])
        return (self.ids.tobytes(), self.labels.tobytes(), packed, self.nodes.tobytes(), self.centres.tobytes(), bounds.tobytes(), self.x.shape[1])

    @staticmethod
    def read(r: dict) -> "BallTree":
        dim, ids = r["dim"], np.frombuffer(r["ids"], np.int64)
        kind = "<i4" if len(r["vectors"]) == 4 * dim * len(ids) else "<f8"
        x = np.frombuffer(r["vectors"], kind).astype(np.float64).reshape(len(ids), dim)
        nodes, bounds = np.frombuffer(r["nodes"], np.int64).reshape(-1, 4), np.frombuffer(r["bounds"], np.int64).reshape(-1, 4)
        centres = np.frombuffer(r["centres"], np.float64).reshape(len(nodes), dim)
        return BallTree(ids, np.frombuffer(r["labels"], np.int64), x, nodes, centres, np.ascontiguousarray(bounds[:, 0]).view(np.float64), bounds[:, 1:])


def plant(rows: DataFrame, scale: float) -> DataFrame:
    """Trees of TREE_ROWS rows at most, of each partition's own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tree(table: pa.Table) -> pa.RecordBatch:
            made = BallTree.build(table["id"].to_numpy(), table["label"].to_numpy(), _matrix(table["v"], scale)).row()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in made], names=[c.split()[0] for c in TREE.split(", ")])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= TREE_ROWS:
                table = pa.Table.from_batches(held)
                yield tree(table.slice(0, TREE_ROWS))
                held, n = table.slice(TREE_ROWS).to_batches(), n - TREE_ROWS
        if n:
            yield tree(pa.Table.from_batches(held))
        release()

    return materialize(rows.mapInArrow(run, TREE), "ball-trees")


class Search:
    """The best k rows of each window (anchor index, least score, greatest score, its mark) over any number of trees."""

    def __init__(self, ids, labels, q, anchor, low, high, mark, same: bool, k: int):
        self.ids, self.labels, self.q, self.same, self.k = ids, labels, q, same, k
        self.anchor, self.low, self.high, self.mark = anchor, low, high, mark
        self.scores, self.found = np.full((len(anchor), k), LOW, np.int64), np.full((len(anchor), k), HIGH, np.int64)

    def over(self, t: BallTree) -> None:
        dim = t.x.shape[1]
        q = self.q[:, :dim] if self.q.shape[1] >= dim else np.pad(self.q, ((0, 0), (0, dim - self.q.shape[1])))
        size = np.sqrt((q * q).sum(1))
        if float(size.max(initial=0.0)) * (float(np.linalg.norm(t.centres[0])) + float(t.radius[0])) >= 2.0**63:
            raise OverflowError("inner products may be beyond 63 bits")
        todo = [(0, np.arange(len(self.anchor)))]
        while todo:
            node, active = todo.pop()
            active = self.alive(t, q, size, node, active)
            if not len(active):
                continue
            begin, end, left, right = t.nodes[node]
            if left < 0:
                self.leaf(t, q, int(begin), int(end), active)
            else:  # the child with the higher centres is visited first
                step = float((q[self.anchor[active]] @ (t.centres[left] - t.centres[right])).sum())
                todo += [(right, active), (left, active)] if step >= 0 else [(left, active), (right, active)]

    def alive(self, t: BallTree, q, size, node: int, active: np.ndarray) -> np.ndarray:
        own = self.anchor[active]
        middle, reach = q[own] @ t.centres[node], size[own] * t.radius[node]
        slack = 1 + 1e-9 * (np.abs(middle) + reach)  # of rounding
        top, bottom = middle + reach + slack, middle - reach - slack
        least, most, _ = t.ranges[node]
        label = self.labels[own]
        keep = (top >= np.maximum(self.low[active], self.scores[active, -1]).astype(np.float64)) & (bottom <= self.high[active].astype(np.float64))
        keep &= (label >= least) & (label <= most) if self.same else ~((label == least) & (label == most))
        return active[keep]

    def products(self, q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
        if float(np.abs(q).max(initial=0.0)) * most * max(1, x.shape[1]) < EXACT:
            return (q @ x.T).astype(np.int64)
        whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
        return (whole(q) @ whole(x).T).astype(np.int64)

    def leaf(self, t: BallTree, q, begin: int, end: int, active: np.ndarray) -> None:
        some, back = np.unique(self.anchor[active], return_inverse=True)
        s = self.products(q[some], t.x[begin:end], t.most)
        ids, alike = t.ids[begin:end], t.labels[begin:end] == self.labels[some][:, None]
        fit = ((alike if self.same else ~alike) & (ids != self.ids[some][:, None]))[back]
        s = s[back]
        kth, last = self.scores[active, -1:], self.found[active, -1:]
        fit &= (s >= self.low[active][:, None]) & (s <= self.high[active][:, None]) & ((s > kth) | (s == kth) & (ids < last))
        hit = np.flatnonzero(fit.any(1))
        if not len(hit):
            return
        rows = active[hit]
        both = np.concatenate([self.scores[rows], np.where(fit[hit], s[hit], LOW)], 1)
        who = np.concatenate([self.found[rows], np.where(fit[hit], ids, HIGH)], 1)
        order = np.lexsort((who, -both), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)

    def result(self) -> pa.RecordBatch:
        w, j = np.nonzero(self.found < HIGH)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.anchor[w]]), pa.array(self.mark[w]), pa.array(self.found[w, j]), pa.array(self.scores[w, j])], names=["anchor_id", "mark", "other_id", "score"])


def search(trees: DataFrame, block: tuple, windows: tuple, same: bool, k: int) -> DataFrame:
    """anchor_id, mark, other_id, score, place: the best k rows of each window; anchor_id and mark name a window."""
    shared = trees.sparkSession.sparkContext.broadcast((block, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Search(*shared.value[0], *shared.value[1], same, k)
        for batch in batches:
            for i in range(batch.num_rows):
                own.over(BallTree.read({c: batch[c][i].as_py() for c in batch.schema.names}))
        yield own.result()
        release()

    each = trees.mapInArrow(run, "anchor_id long, mark long, other_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "mark").orderBy(F.col("score").desc(), "other_id"))
    return each.withColumn("place", place).where(F.col("place") <= k)


def blocks(anchors: DataFrame) -> tuple[DataFrame, list[int]]:
    """Anchors as a table in folders of `block`, none of which exceeds QUERY_BYTES by count."""
    kept = materialize(anchors.withColumn("hash", F.xxhash64("id")), "anchors")
    size = kept.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not size[0]:
        return kept, []
    most = max(1, QUERY_BYTES // (8 * max(1, size[1])))
    n = -(-size[0] // most)
    while True:
        dealt = kept.withColumn("block", F.expr(f"pmod(hash, {n})").cast("int"))
        if dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= most:
            break
        n = n + n // 8 + 1
    path = scratch(kept.sparkSession, "anchor-blocks")
    dealt.select("id", "label", "v", "block").repartition("block").write.partitionBy("block").parquet(path)
    out = kept.sparkSession.read.parquet(path)
    return out, sorted(r[0] for r in out.select("block").distinct().collect())


def hard_negatives(rows: DataFrame, anchors: Column, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", scale: float = 256.0, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `anchors` is a condition on the id;
    negatives satisfy band[0] * positive_score <= 100 * negative_score <= band[1] * positive_score."""
    spark = rows.sparkSession
    trees = plant(usable(rows, id_column, label_column, vector_column), scale)
    asked, numbers = blocks(usable(rows.where(anchors), id_column, label_column, vector_column))
    path, schema = scratch(spark, "hard-negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for number in numbers:
        one = asked.where(F.col("block") == number).select("id", "label", "v").toArrow()
        block = (one["id"].to_numpy(), one["label"].to_numpy(), _matrix(one["v"], scale))
        n = len(block[0])
        every = (np.arange(n), np.full(n, LOW, np.int64), np.full(n, HIGH, np.int64), np.zeros(n, np.int64))
        near = materialize(search(trees, block, every, True, positives).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        at = {k: i for i, k in enumerate(block[0].tolist())}
        asks = sorted({(at[r["anchor_id"]], r["positive_score"]) for r in near.collect()})  # `positives` rows an anchor of the block
        bands = [b for i, s in asks if (b := (i, -(-band[0] * s // 100), band[1] * s // 100, s))[1] <= b[2]]
        windows = tuple(np.array([b[j] for b in bands], np.int64) for j in range(4))
        far = search(trees, block, windows, False, negatives).select("anchor_id", F.col("mark").alias("positive_score"), F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
        near.join(far, ["anchor_id", "positive_score"]).select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{path}/block={number}")
    return spark.read.schema(schema).parquet(path).drop("block") if numbers else spark.createDataFrame([], schema)
