"""Projection of objects into retrieval units, vectors and a property graph, and reads of all three."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from claimforge.functions.ids import item_id, sha
from claimforge.functions.json_ops import at_path, load
from claimforge.functions.text import preview
from claimforge.operators.dml import deactivate, upsert
from claimforge.rules import UNIT_FIELDS
from claimforge.scratch import settle

# Keys under which an item carries its own id, in order.
ITEM_IDS = ("itemId", "claimRef", "stepId", "ruleId")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("given_id", "path", "text")])))
def _units(kind: pd.Series, title: pd.Series, content: pd.Series) -> pd.Series:
    import json

    def words(value) -> str:
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)

    out = []
    for k, t, c in zip(kind, title, content):
        doc, rows = load(c) or {}, []
        items = doc.get(UNIT_FIELDS.get(k, "")) if isinstance(doc, dict) else None
        for i, item in enumerate(items if isinstance(items, list) else []):
            path = f"$.{UNIT_FIELDS[k]}[{i}]"
            given = next((str(item[n]) for n in ITEM_IDS if isinstance(item, dict) and item.get(n)), None)
            text = item.get("question") if k == "QA_PAIR" and isinstance(item, dict) and item.get("question") else at_path(doc, path)
            rows.append({"given_id": given, "path": path, "text": words(text)})
        out.append(rows or [{"given_id": "ROOT", "path": "$", "text": f"{t}\n{words(doc)}"}])
    return pd.Series(out)


def retrieval_units(objects: DataFrame) -> DataFrame:
    """One unit for each item of the type's item field, else one for the whole object; questions stand for their answers."""
    flat = objects.select("knowledge_object_id", "doc_id", "workspace_id", "revision", F.explode(_units("object_type", "title", "content")).alias("u"))
    unit = flat.select("knowledge_object_id", "doc_id", "workspace_id", "revision", item_id(F.col("u.text"), F.col("u.given_id")).alias("item_id"), F.col("u.path").alias("content_path"), F.col("u.text").alias("retrieval_text"))
    return unit.withColumn("retrieval_unit_id", F.concat(F.lit("RU-"), F.upper(F.left(sha(F.concat_ws("|", "knowledge_object_id", "item_id", "content_path")), F.lit(20))))).withColumn("active", F.lit(True))


def vector_sink(old: DataFrame, embedded: DataFrame, package: str, dimension: int) -> DataFrame:
    """The vector table after a package's units: its old ones inactive, new ones upserted; other dimensions are refused."""
    checked = embedded.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding dimension differs"))))
    return upsert(deactivate(old, F.col("doc_id").cast("string") == package), checked, ["retrieval_unit_id"])


def graph(objects: DataFrame, entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): documents contain objects, objects refer to entities, and formal relationships."""
    node = lambda df, i, label, props: df.select(F.col(i).cast("string").alias("id"), F.lit(label).alias("label"), F.to_json(F.struct(*props)).alias("props"))
    nodes = node(objects, "knowledge_object_id", "KnowledgeObject", ["title", "module", "object_type"]).unionByName(node(entities, "entity_id", "BusinessEntity", ["canonical_name", "entity_type"])).unionByName(node(objects.select("doc_id").distinct(), "doc_id", "DocumentPackage", [F.col("doc_id")]))
    contains = objects.select(F.col("doc_id").cast("string").alias("src"), F.col("knowledge_object_id").alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("id"), F.array().cast("array<string>").alias("evidence"))
    refers = objects.select("knowledge_object_id", F.explode("entity_references").alias("r")).select(F.col("knowledge_object_id").alias("src"), F.col("r.entity_id").alias("dst"), F.lit("REFERS_TO").alias("type"), F.col("r.role").alias("role"), F.lit(None).cast("string").alias("id"), F.col("r.evidence").alias("evidence"))
    related = links.select(F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"), F.col("type"), F.lit(None).cast("string").alias("role"), F.col("relationship_id").alias("id"), "evidence")
    return nodes.dropDuplicates(["id", "label"]), contains.unionByName(refers).unionByName(related)


def graph_sink(old_edges: DataFrame, new_edges: DataFrame, package: str) -> DataFrame:
    """Edges after a package: those from the package and from its objects are replaced."""
    mine = new_edges.select("src").distinct().unionByName(old_edges.where((F.col("src") == package) & (F.col("type") == "CONTAINS")).select(F.col("dst").alias("src"))).unionByName(new_edges.sparkSession.createDataFrame([(package,)], "src string")).distinct()
    return old_edges.join(mine, "src", "left_anti").unionByName(new_edges)


def one_hop(edges: DataFrame, nodes: DataFrame, package: str) -> DataFrame:
    """Objects of a package with the entities they refer to, if any."""
    objects = edges.where((F.col("src") == package) & (F.col("type") == "CONTAINS")).select(F.col("dst").alias("object_id"))
    refs = edges.where("type = 'REFERS_TO'").select(F.col("src").alias("object_id"), F.col("dst").alias("entity_id"), "role")
    return objects.join(refs, "object_id", "left").join(nodes.select(F.col("id").alias("object_id"), "props"), "object_id", "left")


def edges_around(edges: DataFrame, package: str) -> DataFrame:
    """Edges that leave the package or one of its objects, in order of type, source and target."""
    objects = edges.where((F.col("src") == package) & (F.col("type") == "CONTAINS")).select(F.col("dst").alias("src")).distinct()
    own = edges.where((F.col("src") == package) & (F.col("type") == "CONTAINS"))
    return own.unionByName(edges.join(objects, "src", "left_semi")).distinct().orderBy("type", "src", "dst")


def reach(edges: DataFrame, starts: DataFrame, depth: int, both_ways: bool = False) -> DataFrame:
    """(start, node, depth): every node within `depth` edges of each start (column node), with its least number of edges; a start
    is at 0. The frontier is joined with the edges once a step, and a node met before isn't met again, so cycles end."""
    pairs = edges.select("src", "dst")
    if both_ways:
        pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = pairs.where("src is not null and dst is not null").distinct()
    front = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).where("node is not null").distinct()
    seen = front
    for step in range(1, depth + 1):
        met = front.join(pairs, front["node"] == pairs["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = settle(met.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(front)
    return seen


def unit_listing(units: DataFrame) -> DataFrame:
    return units.where("active").select("retrieval_unit_id", "knowledge_object_id", "content_path", preview(F.col("retrieval_text")).alias("preview")).orderBy("retrieval_unit_id")


def isolated(sinks: dict[str, Callable[[], int]]) -> dict[str, tuple[str, int | str]]:
    """Run each store's sink; one that fails is reported and doesn't stop the others."""
    out: dict[str, tuple[str, int | str]] = {}
    for name, run in sinks.items():
        try:
            out[name] = ("completed", run())
        except Exception as error:
            out[name] = ("failed", f"{type(error).__name__}: {str(error)[:300]}")
    return out


def evidence_counts(objects: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects, files, inner items and edges of a projection, in one row."""
    a = objects.agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("file_sha256") != "").alias("files"))
    b = units.agg(F.count_if(F.col("content_path") != "$").alias("inner_items"))
    c = edges.agg(F.count(F.lit(1)).alias("edges"))
    return a.crossJoin(b).crossJoin(c)
