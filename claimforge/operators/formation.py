"""Formation of knowledge objects: identity, matches with stored objects, actions, relationships and their files."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimforge.functions.ids import entity_id, fingerprint, identity_key, lineage_key, object_id, relationship_id
from claimforge.functions.json_ops import changed_paths
from claimforge.functions.text import casefold, drop_space, natural_key, same_text_key, strip_space
from claimforge.operators.planning import identity_missing
from claimforge.operators.relational import fuzzy_unique, unique_slots
from claimforge.rules import INVERSES, RuleSet
from claimforge.scratch import settle

SIMILAR = 0.85


def eligible(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(eligible, blocked): candidates with quality issues don't form objects."""
    return candidates.where(F.size("quality_issues") == 0), candidates.where(F.size("quality_issues") > 0).select("doc_id", "candidate_id", "quality_issues")


def mentions(candidates: DataFrame) -> DataFrame:
    flat = candidates.select("doc_id", "workspace_id", "pos", "candidate_id", F.posexplode("mentions").alias("n", "m")).select("doc_id", "workspace_id", "pos", "candidate_id", "n", "m.*")
    return flat.withColumn("entity_id", entity_id(F.col("workspace_id"), F.col("type"), F.col("text")))


def entities(mentioned: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each entity: name and type of its first mention, all mentions sorted, created or reused."""
    order = F.struct("doc_id", "pos", "n")
    grouped = mentioned.groupBy("entity_id").agg(F.min_by("workspace_id", order).alias("workspace_id"), F.min_by("type", order).alias("entity_type"), F.min_by(strip_space(F.col("text")), order).alias("canonical_name"), F.sort_array(F.collect_set(strip_space(F.col("text")))).alias("source_mentions"))
    return grouped.join(stored.select("entity_id", F.lit(True).alias("known")).distinct(), "entity_id", "left").withColumn("action", F.when(F.col("known"), "reused").otherwise("created")).drop("known")


def entity_references(mentioned: DataFrame, homes: DataFrame) -> DataFrame:
    """(knowledge_object_id, entity_references): anchors by entity and role."""
    grouped = mentioned.join(homes, ["doc_id", "candidate_id"]).groupBy("knowledge_object_id", "entity_id", "role").agg(F.sort_array(F.collect_set("anchor")).alias("evidence"))
    return grouped.groupBy("knowledge_object_id").agg(F.sort_array(F.collect_list(F.struct("entity_id", "role", "evidence"))).alias("entity_references"))


def keyed(candidates: DataFrame, rules: RuleSet) -> DataFrame:
    """Candidates with identity key, lineage key (by their naturally first anchor) and the id that both lead to."""
    known = identity_missing(rules, candidates)
    first = F.array_min(F.transform("evidence", lambda a: F.struct(natural_key(a).alias("k"), a.alias("a"))))["a"]
    out = known.withColumn("identity_key", identity_key(F.concat(F.lit("["), "identity_json", F.lit("]")))).withColumn("lineage_key", lineage_key(F.col("module"), F.col("object_type"), F.coalesce(first, F.lit("")), F.col("identity_key")))
    return out.withColumn("own_object_id", object_id(F.col("workspace_id"), F.col("object_type"), F.col("identity_key"))).drop("missing_identity", "identity_json")


def discriminator() -> Column:
    """What tells apart objects of one slot: subject, product and version of version facts, products of strategies."""
    get = lambda p: casefold(strip_space(F.get_json_object("content", p)))
    version = F.concat_ws("|", get("$.subject"), get("$.applicability.product"), get("$.applicability.version"))
    whole = get("$.subject").isNotNull() & get("$.applicability.product").isNotNull() & get("$.applicability.version").isNotNull()
    products = F.from_json(F.get_json_object("content", "$.applicability.products"), "array<string>")
    return F.when((F.col("object_type") == "PRODUCT_VERSION_FACT") & whole, version).when((F.col("object_type") == "SALES_STRATEGY") & (F.size(products) > 0), F.array_join(F.array_sort(F.transform(products, lambda p: casefold(strip_space(p)))), "|"))


def slot_matches(candidates: DataFrame, stored: DataFrame, active: DataFrame) -> DataFrame:
    """(candidate_id, knowledge_object_id, tentative): unique slots of module, type and evidence; among the rest unique slots
    with a discriminator; among the rest version facts whose subjects are alike, each side once. Candidates of documents
    without current objects have nothing to match and are left aside first."""
    slot = lambda df: df.withColumn("slot", F.concat_ws("|", "doc_id", "module", "object_type", F.array_join(F.sort_array("evidence"), ",")))
    old = settle(slot(stored.join(active.select("doc_id", "knowledge_object_id").distinct(), "knowledge_object_id")))
    new = slot(candidates.join(old.select("doc_id").distinct(), "doc_id", "left_semi")).withColumn("cid", F.concat_ws("|", "doc_id", "candidate_id"))
    first = unique_slots(new, old, ["slot"], "cid", "knowledge_object_id").cache()
    rest = lambda df, done, c: df.join(done.select(c), c, "left_anti")
    marked = lambda df: df.withColumn("mark", discriminator()).where("mark is not null")
    second = unique_slots(marked(rest(new, first, "cid")), marked(rest(old, first, "knowledge_object_id")), ["slot", "mark"], "cid", "knowledge_object_id")
    done = settle(first.unionByName(second))
    get = lambda p: F.get_json_object("content", p)
    facts = lambda df: df.where("object_type = 'PRODUCT_VERSION_FACT'").withColumn("subject_text", casefold(drop_space(get("$.subject")))).withColumn("version", casefold(strip_space(get("$.applicability.version")))).where("subject_text <> '' and version <> ''")
    third = fuzzy_unique(facts(rest(new, done, "cid")), facts(rest(old, done, "knowledge_object_id")), ["slot", "version"], "cid", "knowledge_object_id", "subject_text", SIMILAR)
    out = done.withColumn("tentative", F.lit(False)).unionByName(third.select("cid", "knowledge_object_id", F.lit(True).alias("tentative")))
    return out.join(new.select("cid", "doc_id", "candidate_id"), "cid").drop("cid")


def core(kind: Column, content: Column) -> Column:
    """The core by which contents count as equal: a script's text; a question list's answers by question."""
    pairs = F.from_json(F.get_json_object(content, "$.items"), "array<struct<question string, answer string>>")
    qa = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat_ws("=", same_text_key(p["question"]), same_text_key(p["answer"])))), "|")
    return F.when(kind.isin("STANDARD_SCRIPT", "SCRIPT_VARIANT"), same_text_key(F.get_json_object(content, "$.script"))).when(kind == "QA_PAIR", qa)


def form(candidates: DataFrame, stored: DataFrame, lineages: DataFrame, active: DataFrame, rules: RuleSet) -> dict[str, DataFrame]:
    """Objects, their sources, entity mentions and the review verdict of each document.

    stored: knowledge_object_id, revision, content_fingerprint, title, domain, module, object_type, identity_key, content,
    evidence, file_path, file_sha256. lineages: workspace_id, source_lineage_key, knowledge_object_id. active: doc_id,
    knowledge_object_id of the document's current objects."""
    good, blocked = eligible(candidates)
    ready = settle(keyed(good, rules))
    # settled, its size is known: a few matches are broadcast and the candidates stay where they are
    matched = settle(slot_matches(ready, stored, active))
    line = lineages.select("workspace_id", F.col("source_lineage_key").alias("lineage_key"), F.col("knowledge_object_id").alias("lineage_object"))
    homes = ready.join(matched.withColumnRenamed("knowledge_object_id", "matched_object"), ["doc_id", "candidate_id"], "left").join(line, ["workspace_id", "lineage_key"], "left")
    homes = homes.withColumn("knowledge_object_id", F.coalesce("matched_object", "lineage_object", "own_object_id"))
    homes = settle(homes)
    told = mentions(ready)
    refs = entity_references(told, homes.where(F.size("mentions") > 0).select("doc_id", "candidate_id", "knowledge_object_id"))
    order = F.struct("doc_id", "pos")
    group = homes.groupBy("knowledge_object_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("workspace_id").alias("workspace_id"), F.min_by(F.struct("title", "domain", "module", "object_type", "content"), order).alias("p"),
        F.max_by("identity_key", order).alias("identity_key"), F.sort_array(F.collect_set("lineage_key")).alias("lineage_keys"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
        (F.min("content") < F.max("content")).alias("differs"), F.collect_list(F.struct("pos", "candidate_id", "used_claims", "usage", "leaf_count", "attributed_count", "content")).alias("members"), F.max(F.coalesce("tentative", F.lit(False))).alias("tentative"),
    )
    # members are collected once; each list of them is made of that
    traces = F.transform(F.sort_array("members"), lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "candidate_id", "used_claims", "usage", "leaf_count", "attributed_count")]))
    contents = F.sort_array(F.transform("members", lambda x: F.struct(x["pos"].alias("pos"), x["content"].alias("content"))))["content"]
    merged = F.when(F.col("n") == 1, F.col("p.content")).otherwise(F.concat(F.lit('{"mergedItems":['), F.array_join(contents, ","), F.lit("]}")))
    group = group.withColumn("content", merged).withColumn("traces", traces).drop("members").withColumn("candidate_ids", F.array_distinct(F.col("traces.candidate_id")))
    made = group.join(refs, "knowledge_object_id", "left").withColumn("entity_references", F.coalesce("entity_references", F.array().cast(refs.schema["entity_references"].dataType)))
    made = made.withColumn("payload", fingerprint(F.col("p.title"), F.col("p.domain"), F.col("p.module"), F.col("p.object_type"), F.col("content"), F.col("entity_references"), F.col("evidence"), F.col("traces")))
    old = stored.select("knowledge_object_id", F.struct("revision", "content_fingerprint", "title", "domain", "module", "object_type", "identity_key", "content", "evidence", "file_path", "file_sha256").alias("old"))
    seen = settle(made).join(old, "knowledge_object_id", "left")
    same = F.col("old.content_fingerprint") == F.col("payload")
    alike = F.coalesce(core(F.col("p.object_type"), F.col("old.content")) == core(F.col("p.object_type"), F.col("content")), F.lit(False))
    action = F.when(F.col("old").isNull(), "created").when(same | alike, "reused").otherwise("review_required")
    before = active.select("doc_id", "knowledge_object_id").distinct()
    now = homes.select("doc_id", "knowledge_object_id").distinct()
    changed = before.join(now, ["doc_id", "knowledge_object_id"], "left_anti").select("doc_id").unionByName(now.join(before, ["doc_id", "knowledge_object_id"], "left_anti").join(before.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")).distinct().withColumn("identity_changed", F.lit(True))
    done = seen.withColumn("action", action).join(changed, "doc_id", "left").withColumn("action", F.when(F.col("identity_changed") | F.col("tentative"), "review_required").otherwise(F.col("action")))
    stay = F.col("old").isNotNull() & ~same
    # only contents under review go to Python
    held = F.col("action") == "review_required"
    pick = lambda c, new: F.when(stay, F.coalesce(F.nullif(F.col(f"old.{c}"), F.lit("")), new)).otherwise(new).alias(c)
    path = F.coalesce(F.nullif(F.col("old.file_path"), F.lit("")), F.concat(F.lit("knowledge/"), F.concat_ws("/", "p.domain", "p.module", "knowledge_object_id"), F.lit(".md")))
    objects = done.select(
        "knowledge_object_id", "workspace_id", "doc_id", F.coalesce("old.revision", F.lit(1)).alias("revision"), "action", *[pick(c, F.col(f"p.{c}")) for c in ("title", "domain", "module", "object_type")], pick("identity_key", F.col("identity_key")), pick("content", F.col("content")),
        F.when(stay & (F.size("old.evidence") > 0), F.col("old.evidence")).otherwise(F.col("evidence")).alias("evidence"), "entity_references", F.coalesce("old.content_fingerprint", "payload").alias("content_fingerprint"), "lineage_keys", "candidate_ids", "traces",
        F.when(held, changed_paths(F.when(held, F.col("old.content")), F.when(held, F.col("content")))).alias("changed_paths"), F.when(held, F.col("content")).alias("proposed_content"), path.alias("file_path"), F.coalesce("old.file_sha256", F.lit("")).alias("file_sha256"), (F.col("n") > 1).alias("merged"), ((F.col("n") > 1) & F.coalesce("differs", F.lit(False))).alias("ambiguous"),
    )
    objects = settle(objects)
    verdict = objects.groupBy("doc_id").agg(F.count(F.lit(1)).alias("objects"), *[F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "reused", "review_required")], F.count_if("ambiguous").alias("ambiguous"))
    refused = blocked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocked"))
    gone = before.join(now, ["doc_id", "knowledge_object_id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("superseded"))
    verdict = verdict.join(refused, "doc_id", "full_outer").join(gone, "doc_id", "left").fillna(0)
    verdict = verdict.withColumn("status", F.when((F.col("review_required") > 0) | (F.col("blocked") > 0) | (F.col("ambiguous") > 0), "review_required").otherwise("completed"))
    sources = homes.select("knowledge_object_id", "doc_id", "candidate_id", "evidence", "used_claims", "usage")
    return {"objects": objects, "sources": sources, "mentions": told, "verdict": verdict, "blocked": blocked, "lineages": homes.select("workspace_id", F.col("lineage_key").alias("source_lineage_key"), "knowledge_object_id").distinct()}


def relationships(candidates: DataFrame, sources: DataFrame, told: DataFrame, objects: DataFrame) -> DataFrame:
    """Relationships whose ends are objects or entities and whose type is formal; of equal ids the last one stands."""
    refs = sources.select("doc_id", F.col("candidate_id").alias("ref"), F.col("knowledge_object_id").alias("id"), F.lit("knowledge_object").alias("kind")).unionByName(told.select("doc_id", F.col("mention_id").alias("ref"), F.col("entity_id").alias("id"), F.lit("business_entity").alias("kind"))).distinct()
    rel = candidates.select("doc_id", "pos", "candidate_id", F.posexplode("relations").alias("n", "r")).select("doc_id", "pos", "n", "candidate_id", "r.*").drop("kind")
    side = lambda s: refs.select("doc_id", F.col("ref").alias(s), F.col("id").alias(f"{s}_ref"), F.col("kind").alias(f"{s}_kind"))
    both = rel.join(side("source"), ["doc_id", "source"]).join(side("target"), ["doc_id", "target"])
    labels = candidates.sparkSession.createDataFrame(list(INVERSES.items()), "type string, inverse_label string")
    both = both.join(F.broadcast(labels), "type").withColumn("relationship_id", relationship_id(F.col("type"), F.col("source_ref"), F.col("target_ref")))
    last = both.groupBy("relationship_id").agg(F.max_by(F.struct("doc_id", "candidate_id", "type", "inverse_label", "source_ref", "source_kind", "target_ref", "target_kind", "evidence"), F.struct("pos", "n")).alias("x")).select("relationship_id", "x.*")
    rev = objects.select("knowledge_object_id", "revision")
    for s in ("source", "target"):
        last = last.join(rev.select(F.col("knowledge_object_id").alias(f"{s}_ref"), F.col("revision").alias(f"{s}_revision")), f"{s}_ref", "left")
    return last.withColumn("provenance", F.create_map(F.lit("documentPackageId"), F.col("doc_id").cast("string"), F.lit("candidateId"), F.col("candidate_id"))).drop("doc_id", "candidate_id")


def render(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(file_path, markdown, file_sha256): front matter, content by field, evidence and relationships."""
    near = links.select(F.explode(F.array("source_ref", "target_ref")).alias("knowledge_object_id"), "type", "source_ref", "target_ref").distinct().groupBy("knowledge_object_id").agg(F.sort_array(F.collect_set(F.concat_ws(" ", F.lit("-"), "source_ref", "type", "target_ref"))).alias("links"))

    @F.pandas_udf("string")
    def body(content: pd.Series) -> pd.Series:
        def show(value, depth=0):
            pad = "  " * depth
            if isinstance(value, dict):
                return "\n".join(f"{pad}- {k}:" + (f" {v}" if not isinstance(v, (dict, list)) else "\n" + show(v, depth + 1)) for k, v in value.items())
            if isinstance(value, list):
                return "\n".join(f"{pad}- {v}" if not isinstance(v, (dict, list)) else show(v, depth) for v in value)
            return f"{pad}{value}"

        return content.map(lambda t: "\n\n".join(f"## {k}\n\n{show(v)}" for k, v in (json.loads(t) if t else {}).items()))

    front = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("knowledge_object_id", "revision", "domain", "module", "object_type", "identity_key")], F.lit("---"))
    text = F.concat_ws("\n\n", front, F.concat(F.lit("# "), "title"), body("content"), F.concat(F.lit("## evidence\n\n- "), F.array_join("evidence", "\n- ")), F.when(F.size("links") > 0, F.concat(F.lit("## relationships\n\n"), F.array_join("links", "\n"))))
    made = objects.join(near, "knowledge_object_id", "left").select("knowledge_object_id", "domain", "module", "file_path", text.alias("markdown"))
    return made.withColumn("file_sha256", F.sha2("markdown", 256))


def write_markdown(rendered: DataFrame, root: str) -> None:
    """One file for each object at its file_path under `root`, written by the tasks that hold the rows. A file is written
    aside and moved into place, so it appears whole or not at all and a repeated task does no harm; others stay as they are."""

    def write(rows) -> None:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for row in rows:
            path = f"{base.rstrip('/')}/{row['file_path']}"
            folder, name = path.rsplit("/", 1)
            aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
            where.create_dir(folder, recursive=True)
            with where.open_output_stream(aside) as f:
                f.write(row["markdown"].encode())
            where.move(aside, path)

    rendered.select("file_path", "markdown").foreachPartition(write)


def numbered_lines(objects: DataFrame) -> DataFrame:
    """Objects in natural order of their first evidence, numbered within the document."""
    w = Window.partitionBy("doc_id").orderBy(natural_key(F.get("evidence", F.lit(0))), "knowledge_object_id")
    return objects.withColumn("line", F.row_number().over(w))
