"""The engine's entry points: identify, form, project, and reads of what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimforge.operators import candidates as C, claims as K, evaluation as Q, formation as M, planning as P, projection as R, segments as S
from claimforge.operators import dml
from claimforge.operators.dml import Store, append_with_ttl
from claimforge.operators.relational import latest
from claimforge.plans import prompts
from claimforge.rules import RuleSet
from claimforge.scratch import settle
from claimforge.sources import gateways
from claimforge.sources.packages import load_packages, read_gold, read_manifests, read_report
from claimforge.sources.settings import Settings

STORED = "knowledge_object_id string, revision int, content_fingerprint string, title string, domain string, module string, object_type string, identity_key string, content string, evidence array<string>, file_path string, file_sha256 string"


class Engine:
    """Stages are DataFrames. Model answers are written to the store's scratch folder before they are used twice."""

    def __init__(self, spark: SparkSession, root: str, rules: RuleSet | None = None, settings: Settings | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.rules, self.settings = rules or RuleSet.built_in(), settings or Settings()
        self.store = Store(spark, f"{self.root}/store")

    def catalog(self) -> DataFrame:
        return self.rules.joined(self.spark).orderBy("module", "object_type")

    def source_materials(self) -> DataFrame:
        """Packages without their texts, the newest source first."""
        return read_manifests(self.spark, self.root).select("document_package_id", "source_file_name", "processing_method", "status", F.size("anchors").alias("n_anchors")).orderBy(F.col("document_package_id").desc(), "source_file_name")

    def packages(self) -> DataFrame:
        return load_packages(self.spark, self.root, read_manifests(self.spark, self.root)).withColumn("doc_id", F.col("document_package_id"))

    def package(self, package_id: str) -> DataFrame:
        """One package, of which only the files that its manifest names are read."""
        return load_packages(self.spark, self.root, read_manifests(self.spark, self.root), package_id).withColumn("doc_id", F.col("document_package_id"))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        import uuid

        path = f"{self.root}/scratch/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _ask(self, requests: DataFrame, gateway, name: str) -> DataFrame:
        calls = self._keep(gateways.complete(requests, gateway, self.settings.retries, self.settings.concurrency, prompts.json_repair), name)
        return calls.withColumn("doc_id", F.split_part("request_id", F.lit("|"), F.lit(1))).withColumn("part", F.split_part("request_id", F.lit("|"), F.lit(2)).cast("int"))

    def _items(self, calls: DataFrame, field: str) -> DataFrame:
        """Elements of a JSON array in the good answers, numbered in the document."""
        from pyspark.sql import Window

        flat = calls.where("ok").select("doc_id", "part", F.posexplode(F.from_json(F.get_json_object("content", f"$.{field}"), "array<string>")).alias("n", "raw"))
        return flat.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "n")))

    def _aside(self, calls: DataFrame, field: str) -> DataFrame:
        """Weak signals or open items of the good answers: doc_id, pos, claim_id, module, description, reason, evidence, raw."""
        get = lambda k: F.get_json_object("raw", f"$.{k}")
        return self._items(calls, field).select("doc_id", "pos", get("claimId").alias("claim_id"), get("module").alias("module"), get("description").alias("description"), get("reason").alias("reason"), F.coalesce(F.from_json(get("evidence"), "array<string>"), F.array().cast("array<string>")).alias("evidence"), "raw")

    def _realized(self, plans: DataFrame, claims: DataFrame, gateway, purpose: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(calls, accepted, rejected) of one round of realizations."""
        told = self._ask(prompts.realization(P.realization_batches(plans, self.settings.realization_batch), claims, self.rules, purpose), gateway, purpose)
        real = self._items(told, "realizations").select("doc_id", F.coalesce(F.get_json_object("raw", "$.planId"), F.get_json_object("raw", "$.candidateId")).alias("plan_id"), F.col("raw").alias("realization"))
        return told, *C.judge(self._keep(C.realize(plans, claims, real, self.rules), "candidates"), self.rules)

    def _second_try(self, plans: DataFrame, claims: DataFrame, accepted: DataFrame, rejected: DataFrame, calls: DataFrame, gateway) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(calls, accepted, rejected) after rejected candidates that writing once more can mend were realized again, in
        documents with fewer calls than `repair_calls`. A document whose second call fails keeps its first result."""
        again = self._keep(C.repairable(rejected, calls, self.settings.repair_calls).select("doc_id", "candidate_id").distinct(), "repairable")
        if again.isEmpty():
            return calls, accepted, rejected
        some = plans.join(again.select("doc_id", F.col("candidate_id").alias("plan_id")), ["doc_id", "plan_id"], "left_semi")
        told, good, bad = self._realized(some, claims, gateway, "content_repair")
        # a request failed if its last call did
        ends = told.groupBy("doc_id", "request_id").agg(F.max_by("ok", "attempt").alias("ok"))
        answered = ends.groupBy("doc_id").agg(F.min("ok").alias("ok")).where("ok").select("doc_id")
        redone = again.join(answered, "doc_id", "left_semi")
        ours = lambda df: df.join(answered, "doc_id", "left_semi")
        accepted = settle(accepted.unionByName(ours(good)))
        rejected = settle(rejected.join(redone, ["doc_id", "candidate_id"], "left_anti").unionByName(ours(bad).join(good.select("doc_id", "candidate_id"), ["doc_id", "candidate_id"], "left_anti")))
        return calls.unionByName(told), accepted, rejected

    def identify(self, gateway: Callable[[str, str], dict]) -> dict[str, DataFrame]:
        """Claims, plans and candidates of all available packages, with what was rejected or is open.

        Claims that the plans leave uncovered, and the planner gave no reason for, get one repair call, which may append to
        plans or add some; guards then restore branches and objections only of what is still uncovered. Candidates rejected
        for their content alone are realized once more."""
        packages = self.packages().where(F.size("issues") == 0)
        anchors = packages.select("doc_id", F.explode("anchors").alias("a")).select("doc_id", F.col("a.anchorId").alias("anchor_id"))
        cut = S.segment(packages.select("doc_id", "full_markdown"), self.settings.segment_chars)
        found = self._ask(prompts.discovery(cut), gateway, "discover")
        raw = self._items(found, "claims")
        sections = S.document_sections(packages.withColumn("anchor_rows", F.transform("anchors", lambda a: F.struct(a["anchorId"].alias("anchor_id")))), "doc_id", "full_markdown", "anchor_rows").cache()
        modules = [r[0] for r in self.catalog().select("module").distinct().collect()]
        # a claim's evidence stands in the segment that it was found in
        inside = cut.select("doc_id", F.col("index").alias("part"), "markdown").join(packages.select("doc_id", F.transform("anchors", lambda a: F.struct(a["anchorId"].alias("anchor_id"))).alias("anchor_rows")), "doc_id")
        many = cut.groupBy("doc_id").agg(F.max("total").alias("segments"))
        claims, refused = K.validate(raw.select("doc_id", "pos", "part", "raw").join(many, "doc_id"), S.document_sections(inside, ["doc_id", "part"], "markdown", "anchor_rows"), modules)
        claims = self._keep(K.supplement(claims, sections), "claims")
        batched = P.planning_batches(claims, self.settings.planning_batch)
        planned = self._ask(prompts.planning(batched, self.rules), gateway, "plan")
        plans, bad_plans = P.validate_plans(self._items(planned, "objectPlans").select("doc_id", "pos", "raw"), claims, self.rules)
        plans = self._keep(plans, "plans")
        told_open = self._aside(planned, "unresolvedItems")
        missed = self._keep(P.uncovered(plans, claims, self.rules, told_open.where("claim_id is not null")), "missed")
        repair = self._ask(prompts.planning(P.planning_batches(missed, self.settings.planning_batch), self.rules, "coverage_repair"), gateway, "repair")
        more = self._items(repair, "planAugmentations").select("doc_id", F.col("pos").alias("nth"), F.get_json_object("raw", "$.planId").alias("plan_id"), F.from_json(F.get_json_object("raw", "$.sourceClaimIds"), "array<string>").alias("claim_ids"))
        plans, bad_additions = P.augment_plans(plans, more, missed)
        extra, bad_repairs = P.validate_plans(self._items(repair, "objectPlans").select("doc_id", "pos", "raw"), missed, self.rules)
        merged, doubles = P.merge_plans(plans, extra, self.rules)
        merged = self._keep(merged, "merged")
        named = lambda df: df.select("doc_id", "plan_id", "reasons")
        bad_plans = named(bad_plans).unionByName(named(bad_additions)).unionByName(named(bad_repairs)).unionByName(named(doubles))
        open_items = told_open.unionByName(self._aside(repair, "unresolvedItems"))
        left_over = self._keep(P.uncovered(merged, claims, self.rules, open_items.where("claim_id is not null")), "left-over")
        plans = self._keep(P.granularity(P.with_guards(merged, claims, left_over), claims), "plans")
        told, accepted, rejected = self._realized(plans, claims, gateway, "realize")
        calls, accepted, rejected = self._second_try(plans, claims, accepted, rejected, found.unionByName(planned).unionByName(repair).unionByName(told), gateway)
        accepted = C.drop_dangling(accepted)
        used = accepted.select("doc_id", F.explode("used_claims").alias("claim_id")).distinct()
        still = open_items.join(used, ["doc_id", "claim_id"], "left_anti")
        left = C.unresolved(accepted, rejected, P.uncovered(plans, claims, self.rules, open_items.where("claim_id is not null"))).unionByName(still.where("claim_id is not null").groupBy("doc_id", "claim_id").agg(F.min_by("reason", "pos").alias("reason")))
        left = left.groupBy("doc_id", "claim_id").agg(F.first("reason").alias("reason"))
        weak, bad_weak = C.auxiliary(self._aside(planned, "weakSignals").unionByName(self._aside(repair, "weakSignals")), anchors, modules, "weak_signal")
        items, bad_items = C.auxiliary(open_items, anchors, modules)
        return {"claims": claims, "rejected_claims": refused, "plans": plans, "rejected_plans": bad_plans, "candidates": accepted, "rejected_candidates": rejected, "unresolved": left, "weak_signals": weak, "open_items": items, "rejected_items": bad_weak.unionByName(bad_items), "coverage": C.coverage(accepted, weak, items, self.rules), "unclaimed_anchors": K.unclaimed_anchors(anchors, claims, refused), "calls": calls, "metrics": P.granularity_metrics(plans, claims), "usage": gateways.usage(calls)}

    def score(self, result: dict[str, DataFrame], *roots: str) -> dict[str, DataFrame]:
        """Groups, strays and reports against gold files, and what keeps each document from release (doc_id, blocker). A document
        without a gold file has the blocker that nothing was reviewed."""
        gold = read_gold(self.spark, *roots).withColumnRenamed("package_id", "doc_id")
        opened = result["unresolved"].join(result["claims"].select("doc_id", "claim_id", F.col("evidence.anchor_id").alias("a")), ["doc_id", "claim_id"]).select("doc_id", F.explode("a").alias("anchor_id"))
        groups = Q.gold_groups(gold)
        # a gold file may ask for evidence behind each field
        asks = F.coalesce(F.get_json_object("gold", "$.requireFieldEvidence") == "true", F.lit(False))
        strict = groups.join(gold.select("doc_id", asks.alias("strict")), "doc_id")
        scored = None
        for on in (False, True):
            part = Q.evaluate(strict.where(F.col("strict") == on).drop("strict"), result["candidates"], result["claims"], opened, on)
            scored = part if scored is None else scored.unionByName(part)
        stray = Q.strays(scored, result["candidates"])
        compat = Q.compatibility(gold, self.rules.pins, self.packages().select("doc_id", "source_sha256", "full_markdown_sha256", "anchors"))
        rep = settle(Q.report(scored, stray, result["candidates"], result["claims"], compat, gold, opened))
        claims, left = result["claims"], result["unresolved"].select("doc_id", "claim_id")
        named = left.join(claims.select("doc_id", "claim_id", F.col("evidence.anchor_id").alias("evidence")), ["doc_id", "claim_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
        refused = result["rejected_claims"].select("doc_id", "claim_id") if "rejected_claims" in result else left.limit(0)
        blockers = Q.release_blockers(rep, refused, gold, left, Q.non_blocking(scored, groups, named, claims))
        bare = claims.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(rep.select("doc_id"), "doc_id", "left_anti").withColumn("blocker", F.lit("no gold file was reviewed"))
        return {"groups": scored, "strays": stray, "report": rep, "blockers": settle(blockers.unionByName(bare))}

    def release(self, result: dict[str, DataFrame], package_id: str, run_id: str, *roots: str, workspace_id: str = "w", embedder=None) -> dict[str, object]:
        """Score a package's result against the gold files of `roots`, form its objects and commit them; whatever blocks the
        release holds the build for review."""
        blockers = self.score(result, *roots)["blockers"]
        candidates = result["candidates"].where(F.col("doc_id").cast("string") == package_id).withColumn("workspace_id", F.lit(workspace_id))
        return self.commit(self.form(candidates), package_id, run_id, blockers, embedder)

    def _stored(self, name: str, like: DataFrame) -> DataFrame:
        return self.store.read(name) if name in self.store.current() else like.limit(0)

    def form(self, candidates: DataFrame, stored: DataFrame | None = None, lineages: DataFrame | None = None, active: DataFrame | None = None) -> dict[str, DataFrame]:
        """Objects of the candidates against the stored state, which is the store's own where none is given."""
        none = lambda schema: self.spark.createDataFrame([], schema)
        if stored is None:
            stored = self._stored("objects", none(STORED)).select(*[c.split()[0] for c in STORED.split(", ")])
        if lineages is None:
            lineages = self._stored("lineages", none("workspace_id string, source_lineage_key string, knowledge_object_id string"))
        if active is None:
            sources = self._stored("object_sources", none("document_package_id string, knowledge_object_id string, active boolean"))
            active = sources.where("active").select(F.col("document_package_id").alias("doc_id"), "knowledge_object_id")
        made = M.form(candidates, stored, lineages, active, self.rules)
        made["relationships"] = M.relationships(candidates, made["sources"], made["mentions"], made["objects"])
        return made

    def commit(self, made: dict[str, DataFrame], package_id: str, run_id: str, blockers: DataFrame | None = None, embedder=None) -> dict[str, object]:
        """Settle one package's build: the gate, the tables in one snapshot, its files, then the vector and graph stores. Without an
        embedding service no vectors are stored, which is reported as that store's failure.

        A build under review, by its own verdict or for a blocker (doc_id, blocker), leaves a build result and changes nothing
        else. A store that fails is reported and doesn't undo the commit or stop the other."""
        own = lambda df: df.where(F.col("doc_id").cast("string") == package_id)
        base = self.store.version()
        verdict = own(made["verdict"]).first()
        reasons = [r["blocker"] for r in own(blockers).orderBy("blocker").collect()] if blockers is not None else []
        status = "completed" if verdict is not None and verdict["status"] == "completed" and not reasons else "review_required"
        objects = own(made["objects"])
        links = made["relationships"].withColumn("doc_id", F.col("provenance")["documentPackageId"]).where(F.col("doc_id") == package_id)
        now = F.current_timestamp()
        files = M.render(objects, links)
        known = self._stored("entities", self.spark.createDataFrame([], "entity_id string"))
        entities = M.entities(own(made["mentions"]), known).drop("action").withColumn("created_at", now)
        rows = objects.drop("action", "file_sha256", "changed_paths", "proposed_content", "merged", "ambiguous", "lineage_keys", "candidate_ids", "traces")
        build = {
            "objects": rows.join(files.select("knowledge_object_id", "file_sha256"), "knowledge_object_id").withColumn("status", F.lit("active")).withColumn("created_at", now),
            "object_sources": own(made["sources"]).withColumn("document_package_id", F.lit(package_id)).withColumn("run_id", F.lit(run_id)).withColumn("active", F.lit(True)).drop("doc_id"),
            "relationships": links.drop("provenance", "doc_id").withColumn("status", F.lit("active")),
            "relationship_sources": links.select("relationship_id", F.lit(package_id).alias("document_package_id"), F.lit(run_id).alias("run_id"), F.lit(True).alias("active")),
            "entities": entities,
            "lineages": made["lineages"].join(own(made["sources"]).select("knowledge_object_id").distinct(), "knowledge_object_id", "left_semi"),
            "build_results": self.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(package_id).alias("document_package_id"), F.lit(status).alias("status"), F.array(*[F.lit(r) for r in reasons]).cast("array<string>").alias("blockers"), now.alias("created_at")),
        }
        build = {name: settle(df) for name, df in build.items()}
        self.store.write(dml.commit_formation({name: self._stored(name, df) for name, df in build.items()}, build, package_id, status), package_id, base)
        report: dict[str, object] = {"status": status, "blockers": reasons}
        if status == "completed":
            M.write_markdown(files, self.root)  # after the tables: no file of a build that isn't in force
            report["sinks"] = R.isolated({"vectors": lambda: self._vectors(build["objects"], package_id, embedder), "graph": lambda: self._graph(build, package_id)})
        return report

    def _vectors(self, objects: DataFrame, package_id: str, embedder) -> int:
        units = settle(self.project(objects, None, None, embedder)["units"])
        self.store.write({"retrieval_units": R.vector_sink(self._stored("retrieval_units", units), units, package_id, self.settings.embedding_dimension)}, package_id)
        return units.count()

    def _graph(self, build: dict[str, DataFrame], package_id: str) -> int:
        nodes, edges = (settle(df) for df in R.graph(build["objects"], build["entities"], build["relationships"]))
        self.store.write({"nodes": dml.upsert(self._stored("nodes", nodes), nodes, ["id", "label"]), "edges": R.graph_sink(self._stored("edges", edges), edges, package_id)})
        return edges.count()

    def project(self, objects: DataFrame, entities: DataFrame | None, links: DataFrame | None, embedder=None) -> dict[str, DataFrame]:
        """Retrieval units with their vectors and, where entities and links are given, nodes and edges."""
        if embedder is None:
            raise ValueError("vectors need an embedding service")
        units = gateways.embed(R.retrieval_units(objects), embedder, self.settings.embedding_dimension, self.settings.embedding_batch)
        if entities is None or links is None:
            return {"units": units}
        nodes, edges = R.graph(objects, entities, links)
        return {"units": units, "nodes": nodes, "edges": edges}

    def save_run(self, run: DataFrame) -> None:
        """Append a run (run_id, document_package_id, status, result_json, created_at) with its time to live; expired runs go."""
        old = self.store.read("runs") if "runs" in self.store.current() else run.withColumn("expires_at", F.current_timestamp()).limit(0)
        self.store.write({"runs": append_with_ttl(old, run, self.settings.retention_hours)})

    def runs(self, package_id: str, limit: int = 5) -> DataFrame:
        """The latest live runs of a package, oldest first; the limit is 1 to 20."""
        if not 1 <= limit <= 20:
            raise ValueError("limit is 1 to 20")
        live = self.store.read("runs").where((F.col("expires_at") > F.current_timestamp()) & (F.col("document_package_id") == package_id))
        return latest(live, "document_package_id", "created_at", "run_id", limit).drop("rank").orderBy("created_at", "run_id")

    def run(self, run_id: str) -> DataFrame:
        return self.store.read("runs").where((F.col("run_id") == run_id) & (F.col("expires_at") > F.current_timestamp()))

    def knowledge_objects(self, package_id: str | None = None) -> DataFrame:
        objects = self.store.read("objects")
        return objects if package_id is None else objects.where(F.col("doc_id").cast("string") == package_id)

    def around(self, node: str, depth: int = 1, both_ways: bool = False) -> DataFrame:
        """Nodes of the stored graph within `depth` (1 to 5) edges of one: node, depth, label, props."""
        if not 1 <= depth <= 5:
            raise ValueError("the depth is 1 to 5")
        version = self.store.version()
        found = R.reach(self.store.read("edges", version=version), self.spark.createDataFrame([(node,)], "node string"), depth, both_ways)
        return found.where("depth > 0").join(self.store.read("nodes", version=version).withColumnRenamed("id", "node"), "node", "left").select("node", "depth", "label", "props")

    def vectors(self, package_id: str) -> DataFrame:
        """The active retrieval units of a package with their stored vectors, out of its bucket alone."""
        return self.store.read("retrieval_units", package_id).where("active")

    def evaluation(self, report_id: str) -> DataFrame:
        return read_report(self.spark, f"{self.root}/evaluations", report_id)

    def health(self) -> dict[str, str]:
        return {"status": "ok" if not self.rules.issues else "rules have issues", "rules": self.rules.version, "spark": self.spark.version}
