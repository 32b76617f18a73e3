"""Similarity join of short texts: an exact prefix filter over rare q-grams in front of the Ratcliff-Obershelp ratio.

The ratio 2M / (n + m) counts M characters matched in order, so texts at `least` or more match M = ceil(least (n + m) / 2) of
them: n - M characters of one text and m - M of the other are left over. A left-over character takes at most q of its own
text's q-grams away, and one put in between takes at most q - 1, so at most q (n - M) + (q - 1) (m - M) of a text's distinct
q-grams are missing from the other. Hence, in one order of all q-grams, rarest first, the first (that many + 1) of both
texts share one. These prefixes are the index; pairs that meet there must also satisfy the length bound and the
count bound of their own lengths before the ratio is computed. Texts with too few q-grams for the bound (of very few or
repeating characters) meet all texts of an admissible length instead. Nothing is left out.

Only pairs matter of which each side has no other, so equal texts are folded into one node with a count, and a first pass
over neighbours in two sorted orders finds nodes that have two partners; two such nodes are never compared again. A mass
of like texts therefore costs its size, not its square.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from claimforge.functions.numbers import gestalt_ratio
from claimforge.scratch import settle

#: Frequencies of q-grams are kept by hash in so many bins: any order is right, this one is close to rarest first.
BINS = 4096
#: Neighbours of a node in a sorted order that the first pass looks at, on either side.
BESIDE = 2
#: Texts up to the second length are indexed by pairs of characters, those from the first on by triples, if both are of use.
SHORT = 15
EPS = 1e-9


def sizes(least: float) -> list[tuple[int, int, int]]:
    """(q, shortest and longest text) of the q-grams that index texts at `least`; two admissible partners always share one."""
    if least > 0.82:
        return [(2, 0, int(SHORT * (2 - least) / least) + 1), (3, SHORT, 1 << 30)]
    return [(2 if least > 0.7 else 1, 0, 1 << 30)]


def partner_lengths(n: Column, least: float) -> tuple[Column, Column]:
    """The least and greatest length of a text that can be like one of length n."""
    return F.ceil(n * (least / (2 - least)) - EPS).cast("int"), F.floor(n * ((2 - least) / least) + EPS).cast("int")


def matched(n: Column, m: Column, least: float) -> Column:
    """How many characters must match."""
    return F.ceil((n + m) * (least / 2) - EPS).cast("int")


def missing(n: Column, m: Column, q: int, least: float) -> Column:
    """How many distinct q-grams of the first text the second may lack."""
    hit = matched(n, m, least)
    return q * (n - hit) + (q - 1) * (m - hit)


def grams(c: Column, q: int) -> Column:
    """The distinct q-grams of a text."""
    n = F.char_length(c)
    return F.when(n >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(c, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def _bin(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BINS)).cast("int")


def index(nodes: DataFrame, block: list[str], least: float) -> tuple[DataFrame, DataFrame]:
    """Prefix entries (block, node, side, chars, gram) of all nodes, and the nodes that their prefixes can't stand for."""
    low, high = partner_lengths(F.col("chars"), least)
    entries, weak = None, None
    for q, shortest, longest in sizes(least):
        own = nodes.where(F.col("chars").between(shortest, longest)).withColumn("grams", grams(F.col("text"), q))
        count = {r["bin"]: r["n"] for r in own.select(F.explode("grams").alias("gram")).groupBy(_bin(F.col("gram")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}  # BINS rows at most
        often = F.split(F.lit(",".join(str(count.get(i, 0)) for i in range(BINS))), ",").cast("array<long>")  # a constant of the plan
        lost = F.array_max(F.transform(F.sequence(low, high), lambda m: missing(F.col("chars"), m, q, least)))
        own = own.withColumn("lost", lost)
        ordered = F.array_sort(F.transform("grams", lambda g: F.struct(F.get(often, _bin(g)).alias("often"), g.alias("gram"))))
        one = own.select(*block, "node", "side", "chars", F.explode(F.transform(F.slice(ordered, F.lit(1), F.col("lost") + 1), lambda x: F.concat(F.lit(str(q)), x["gram"]))).alias("gram"))
        few = own.where(F.size("grams") <= F.col("lost")).select(*block, "node", "side", "chars")
        entries, weak = (one, few) if entries is None else (entries.unionByName(one), weak.unionByName(few))
    return entries, weak.distinct()


def crowded(nodes: DataFrame, block: list[str], least: float, same: bool) -> DataFrame:
    """Nodes that have two partners among their neighbours by text, or by the text read backwards: each row meets the
    BESIDE rows before it, in order, so a hot block costs its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque(maxlen=BESIDE)
        for batch in batches:
            full = []
            for r in batch.to_pylist():
                key = tuple(r[c] for c in block)
                alike = same and r["n"] > 1 and SequenceMatcher(None, r["text"], r["text"]).ratio() >= least  # not so for long texts of common characters only
                partners = r["n"] - 1 if alike else 0
                for other in held:
                    if other["key"] != key or not same and other["side"] == r["side"]:
                        continue
                    a, b = (r, other) if (r["side"], r["first"]) < (other["side"], other["first"]) else (other, r)
                    m = SequenceMatcher(None, a["text"], b["text"])
                    if m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least:
                        partners += other["n"]
                        other["partners"] += r["n"]
                        if other["partners"] >= 2:
                            full.append(other["node"])
                if partners >= 2:
                    full.append(r["node"])
                held.append(r | {"key": key, "partners": partners})
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64())], names=["node"])

    columns = [*block, "node", "side", "text", "n", "first"]
    found = None
    for order in (F.col("text"), F.reverse("text")):
        rows = nodes.select(*columns).repartitionByRange(*[F.col(c) for c in block], order, F.col("node")).sortWithinPartitions(*[F.col(c) for c in block], order, F.col("node"))
        one = rows.mapInArrow(run, "node long")
        found = one if found is None else found.unionByName(one)
    return found.distinct().withColumn("full", F.lit(True))


def candidate_pairs(nodes: DataFrame, block: list[str], least: float, same: bool) -> DataFrame:
    """Distinct (l, r) nodes of a block that the bounds let through, with their texts; at most one of two is crowded.
    `nodes`: block, node, side (0 left, 1 right; all 0 for one table), text, chars, n, full."""
    entries, weak = index(nodes, block, least)
    low, high = partner_lengths(F.col("chars"), least)
    sided = lambda df, side: df if same else df.where(F.col("side") == side)
    named = lambda df, p: df.select(*block, *[F.col(c).alias(p + c) for c in df.columns if c not in (*block, "gram", "length")], *[c for c in df.columns if c in ("gram", "length")])
    fits = 2 * F.least("l_chars", "r_chars") >= least * (F.col("l_chars") + F.col("r_chars")) - EPS
    full = nodes.select("node", "full")
    entries = entries.join(full, "node")
    met = named(sided(entries, 0), "l_").join(named(sided(entries, 1), "r_"), [*block, "gram"]).where(fits & ~(F.col("l_full") & F.col("r_full")))
    every = nodes.select(*block, "node", "side", "chars", "full", F.col("chars").alias("length"))
    spread = weak.join(full, "node").withColumn("length", F.explode(F.sequence(low, high)))
    ways = [(spread, every)] if same else [(spread, every), (every, spread)]
    pairs = met.select(F.col("l_node").alias("l"), F.col("r_node").alias("r"))
    for a, b in ways:
        by_length = named(sided(a, 0), "l_").join(named(sided(b, 1), "r_"), [*block, "length"]).where(fits & ~(F.col("l_full") & F.col("r_full")))
        pairs = pairs.unionByName(by_length.select(F.col("l_node").alias("l"), F.col("r_node").alias("r")))
    if same:
        pairs = pairs.where("l <> r").select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"))
    texts = lambda p: nodes.select(F.col("node").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("text", "chars", "n", "first")])
    near = pairs.distinct().join(texts("l"), "l").join(texts("r"), "r")
    if same:  # the ratio isn't the same both ways: the text of the lesser id is the first
        turn = F.col("l_first") > F.col("r_first")
        near = near.select(*[F.when(turn, F.col(x + c)).otherwise(F.col(y + c)).alias(y + c) for c in ("", "_text", "_chars", "_n", "_first") for x, y in (("r", "l"), ("l", "r"))])
    q = sizes(least)[0][0]
    a, b, n, m = grams(F.col("l_text"), q), grams(F.col("r_text"), q), F.col("l_chars"), F.col("r_chars")
    shared = F.size(F.array_intersect(a, b))
    return near.where((shared >= F.size(a) - missing(n, m, q, least)) & (shared >= F.size(b) - missing(m, n, q, least)))


def fuzzy_unique(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, text: str, least: float, same: bool = False) -> DataFrame:
    """Pairs of a block whose texts are at least so similar, where each side has no other such pair: left_id, right_id, ratio.
    `same`: both sides are one table, whose rows are paired once, the lesser id on the left, and may have no other pair
    on either side. A null text counts as empty; a null id or a null in a block matches nothing."""

    def folded(df: DataFrame, key: str, side: int) -> DataFrame:
        rows = df.select(*block, F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropna(subset=[*block, "id"])
        return rows.groupBy(*block, "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).withColumn("side", F.lit(side))

    all_nodes = folded(left, left_id, 0) if same else folded(left, left_id, 0).unionByName(folded(right, right_id, 1))
    nodes = settle(all_nodes.withColumn("chars", F.char_length("text")).withColumn("node", F.monotonically_increasing_id()))
    nodes = settle(nodes.join(crowded(nodes, block, least, same), "node", "left").withColumn("full", F.coalesce("full", F.lit(False))))
    near = candidate_pairs(nodes, block, least, same).withColumn("ratio", gestalt_ratio("l_text", "r_text")).where(F.col("ratio") >= least)
    near = settle(near.select("l", "r", "l_n", "r_n", "ratio"))
    ends = near.select(F.col("l").alias("node"), F.col("r_n").alias("k")).unionByName(near.select(F.col("r").alias("node"), F.col("l_n").alias("k"))).groupBy("node").agg(F.sum("k").alias("partners"))
    ids = lambda p: nodes.where("not full").select(F.col("node").alias(p), F.col("n").alias(f"{p}_own"), F.col("first").alias(f"{p}_id"))
    partners = lambda p: ends.select(F.col("node").alias(p), F.col("partners").alias(f"{p}_partners"))
    alone = near.where("l_n = 1 and r_n = 1")
    for p in ("l", "r"):
        alone = alone.join(ids(p), p).join(partners(p).where(f"{p}_partners = 1"), p)
    if not same:
        return alone.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "ratio")
    apart = alone.select(F.least("l_id", "r_id").alias(left_id), F.greatest("l_id", "r_id").alias(right_id), "ratio")
    # two rows of one text, and of no text like it
    twins = nodes.where("n = 2 and not full").join(ends, "node", "left_anti").withColumn("ratio", gestalt_ratio("text", "text")).where(F.col("ratio") >= least)
    return apart.unionByName(twins.select(F.col("first").alias(left_id), F.col("last").alias(right_id), "ratio"))
