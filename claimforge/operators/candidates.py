"""Candidates: realizations meet their plans, content is normalised and attributed to claims, contracts are checked.

Joins, duplicate checks and roll-ups are DataFrame operations. What rewrites one candidate's JSON content runs in one
Arrow pass over candidates that carry their claims along (a plan's claims are bounded by its planning batch).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from claimforge.functions.json_ops import REFERENCE_KEYS, at_path, canonical_json, leaves, walk
from claimforge.functions.text import EVIDENCE_MARKS
from claimforge.operators.claims import resolve_macros
from claimforge.operators.contracts import REPAIRABLE, VIOLATION, reason, with_violations
from claimforge.operators.planning import PLAN, classification, links
from claimforge.operators.relational import priority_rollup
from claimforge.rules import RuleSet
from claimforge.scratch import settle

SKIP = frozenset(REFERENCE_KEYS)
BRANCH_WORDS = ("客户", "异议", "授权", "沟通")
# Facts that a product's verified pages state and content must carry: module, object type, what the content
# speaks of, what it doesn't say yet (null: the list lacks the fact), the fact's pattern, the list that takes it.
BACKFILL = [
    ("D1.2", "POLICY_RULE_SET", "等待期", None, r"意外无等待期[；;，, ]+疾病\s*7\s*天等待期", "rulesOrSteps"),
    ("D1.2", "BUSINESS_PROCESS", "在线药房", "全国省份通常1-3天到达", r"订单物流三通一达配送，全国省份通常1-3天到达，偏远地区除外", "exceptions"),
]
# Fixed value: the heading of a numbered highlight, alone on its line.
HIGHLIGHT = r"亮点\s*([1-6])\s*\n"
# Fields of content that must be lists.
LIST_FIELDS = {"CUSTOMER_OBJECTION": ("expressions", "rootConcernHypotheses", "resolutionElements"), "QA_PAIR": ("items",), "TERM": ("terms",), "BUSINESS_PROCESS": ("rulesOrSteps",), "POLICY_RULE_SET": ("rulesOrSteps",), "SALES_STRATEGY": ("triggerConditions", "actions"), "DECISION_RULE": ("triggerConditions", "actions")}


def empty(v) -> bool:
    return v is None or v == "" or v == [] or v == {}


def plain(text: str) -> str:
    return "".join(c for c in text.casefold() if not c.isspace() and c not in EVIDENCE_MARKS)


def critical(module: str, kind: str, content) -> set[str]:
    """Leaves that must be attributed for a module and type."""
    paths = {p for p, _ in walk(content, "$", SKIP, [])}
    rules = {
        "D1.1": r"\$\.(facts|limitations)\[",
        "D1.2": r"\$\.(preconditions|exceptions)\[|\$\.rulesOrSteps\[.*(\.description|\[\d+\])$",
    }
    typed = {
        ("D3.2", "SALES_STRATEGY"): r"\$\.(triggerConditions\[|decisionLogic|actions\[)", ("D3.2", "DECISION_RULE"): r"\$\.(triggerConditions\[|decisionLogic|actions\[)",
        ("D4.2", "STANDARD_SCRIPT"): r"\$\.script", ("D4.1", "CUSTOMER_OBJECTION"): r"\$\.(expressions|rootConcernHypotheses)\[|\$\.resolutionElements\[.*\.detail$", ("D4.2", "QA_PAIR"): r"\$\.items\[",
    }
    rule = rules.get(module) or typed.get((module, kind))
    return {p for p in paths if rule and re.match(rule, p)}


class Work:
    """One candidate while its content is put in order. `notes` lists what was changed, in order."""

    def __init__(self, row: dict):
        self.module, self.kind = row["module"], row["object_type"]
        self.claims = [{**c, "attributes": json.loads(c["attributes"] or "{}"), "kind": c["claim_kind"]} for c in row["claims"]]
        self.by_id = {c["claim_id"]: c for c in self.claims}
        self.issues, self.notes = [], []
        realization = json.loads(row["realization"]) if row["realization"] else {}
        self.has_usage = "claimUsage" in realization
        content = resolve_macros(realization.get("content") or {}, self.by_id, self.issues)
        self.content = content if isinstance(content, dict) else {"value": content}
        self.usage = [u for u in realization.get("claimUsage") or [] if isinstance(u, dict)]
        self.omitted = [o for o in realization.get("omittedClaims") or [] if isinstance(o, dict)]
        self.mentions, self.relations = realization.get("entityMentions") or [], realization.get("relations") or []
        self.unresolved: list[tuple[str, str]] = []

    def note(self, field: str, why: str) -> None:
        self.notes.append(f"{field}: {why}")

    def use(self, claim_id: str, paths: list[str], role: str = "supporting") -> None:
        self.usage.append({"claimId": claim_id, "role": role, "contentPaths": paths})

    # steps, in the order in which they apply

    def shape(self) -> None:
        """Lists that came as single values become lists."""
        for f in LIST_FIELDS.get(self.kind, ()):
            if isinstance(self.content.get(f), (str, dict)) and self.content[f]:
                self.content[f] = [self.content[f]]
                self.note(f, "single value made a list")

    def replace_highlights(self) -> None:
        """Exactly six numbered highlights in the source replace a selling point's checks."""
        if self.kind != "SELLING_POINT":
            return
        found = {}
        for c in self.claims:
            for e in c["evidence"]:
                # pieces of the text: before the first heading, then number and body by turns
                pieces = re.split(HIGHLIGHT, e["source_text"] or "")
                for number, body in zip(pieces[1::2], pieces[2::2]):
                    said = [line.strip() for line in body.splitlines() if line.strip()]
                    if said:  # a second line of a character or two is the end of a broken first one
                        found[number] = (c["claim_id"], f"亮点{number}：" + "".join(said[:1] + [x for x in said[1:2] if len(x) <= 2]))
        if len(found) == 6:
            self.content["observableChecks"] = [found[k][1] for k in sorted(found)]
            self.usage = [u for u in self.usage if not any(str(p).startswith("$.observableChecks") for p in u.get("contentPaths") or [])]
            for i, k in enumerate(sorted(found)):
                self.use(found[k][0], [f"$.observableChecks[{i}]"], "primary")
            self.note("observableChecks", "numbered highlights of the source")

    def backfill(self) -> None:
        """Facts of the verified sources that content on their subject lacks; the first source that has one gives it."""
        text = json.dumps(self.content, ensure_ascii=False)
        for module, kind, subject, said, pattern, field in BACKFILL:
            if (self.module, self.kind) != (module, kind) or subject not in text or not isinstance(self.content.get(field, []), list):
                continue
            hit = next(((c["claim_id"], m[0]) for c in self.claims for e in c["evidence"] if (m := re.search(pattern, e["source_text"] or ""))), None)
            if hit and (said not in text if said else hit[1] not in self.content.get(field, [])):
                self.content[field] = [*self.content.get(field, []), hit[1]]
                self.use(hit[0], [f"$.{field}[{len(self.content[field]) - 1}]"])
                self.note(field, "verified value of the source added")

    def objections(self) -> None:
        """Expressions come from the verified claims; a detail that repeats one becomes the one known response."""
        if self.kind != "CUSTOMER_OBJECTION":
            return
        texts = lambda k: list(dict.fromkeys(c["attributes"][k].strip() for c in self.claims if c["kind"] == "objection" and isinstance(c["attributes"].get(k), str) and c["attributes"][k].strip()))
        said, answers = texts("expression"), texts("responseContext")
        if said and self.content.get("expressions") != said:
            self.content["expressions"] = said
            self.note("expressions", "taken from verified claims")
        items = self.content.get("resolutionElements")
        if isinstance(items, list) and len(answers) == 1:
            fixed = [{**i, "detail": answers[0]} if isinstance(i, dict) and i.get("detail") in said else i for i in items]
            if fixed != items:
                self.content["resolutionElements"] = fixed
                self.note("resolutionElements", "a repeated expression gave way to the response")

    def questions(self) -> None:
        """Questions of verified claims that the items lack are added."""
        if self.kind != "QA_PAIR":
            return
        items = self.content.get("items") if isinstance(self.content.get("items"), list) else []
        known, added = {i.get("claimRef") for i in items if isinstance(i, dict)}, []
        for c in self.claims:
            q, a = (c["attributes"].get(k) for k in ("question", "answer"))
            if c["kind"] == "qa" and c["claim_id"] not in known and isinstance(q, str) and q.strip() and isinstance(a, str) and a.strip():
                items = [*items, {"question": q.strip(), "answer": a.strip(), "claimRef": c["claim_id"]}]
                self.use(c["claim_id"], [f"$.items[{len(items) - 1}].{k}" for k in ("question", "answer")], "primary")
                added.append(c["claim_id"])
        if added:
            self.content |= {"items": items, "factReferences": list(dict.fromkeys([*(self.content.get("factReferences") or []), *added]))}
            self.has_usage = True
            self.note("items", "questions of verified claims added")

    def check_usage(self) -> None:
        """Usage of known claims, spread to leaves; repeated ones go, invalid ones leave their claim unresolved."""
        kept, seen = [], set()
        for u in self.usage:
            claim, paths = self.by_id.get(u.get("claimId")), u.get("contentPaths")
            if claim is None or not isinstance(paths, list) or u.get("role", "supporting") not in ("primary", "supporting"):
                continue
            found = list(dict.fromkeys(leaf for p in paths for leaf in self.spread(p)))
            key = (claim["claim_id"], tuple(found))
            if found and key not in seen:
                seen.add(key)
                kept.append({"claimId": claim["claim_id"], "role": u.get("role", "supporting"), "contentPaths": found})
            elif not found:
                self.unresolved.append((claim["claim_id"], "usage points to no knowledge in the content"))
        self.usage = kept

    def spread(self, path) -> list[str]:
        if not isinstance(path, str) or not re.fullmatch(r"\$(\.[A-Za-z_][A-Za-z0-9_-]*|\[\d+\])*", path):
            return []
        path = "$." + path[len("$.content.") :] if path.startswith("$.content.") else path
        if any(k in SKIP for k in re.findall(r"\.([^.\[]+)", path)):
            return []
        return [p for p, _ in walk(at_path(self.content, path), path, SKIP, [])]

    def attributed(self) -> set[str]:
        return {p for u in self.usage for p in u["contentPaths"]}

    def match_exactly(self) -> None:
        """Critical leaves of four or more characters are attributed to the first claim whose text holds them."""
        for path in sorted(critical(self.module, self.kind, self.content) - self.attributed()):
            value = at_path(self.content, path)
            text = plain(value) if isinstance(value, str) else ""
            if len(text) < 4:
                continue
            for c in self.claims:
                said = plain(" ".join([c["statement"], c["subject"], json.dumps(c["attributes"], ensure_ascii=False, sort_keys=True), *(e["exact_quote"] or "" for e in c["evidence"])]))
                given = [plain(v) for v in c["attributes"].values() if isinstance(v, str)]
                if text in said or any(len(v) >= 4 and v in text for v in given):
                    self.use(c["claim_id"], [path])
                    self.note("claimUsage", f"{path} found in a claim's text")
                    break

    def prune(self) -> None:
        """Parts of processes, rules and strategies that no claim backs are taken out or rebuilt from the claims."""
        if not self.has_usage or self.module not in ("D1.2", "D3.2"):
            return
        have, before = self.attributed(), json.dumps(self.content, sort_keys=True)
        under = lambda p: any(q == p or q.startswith((p + ".", p + "[")) for q in have)
        trim = lambda items, field, keep: [{k: v for k, v in x.items() if k in keep or under(f"$.{field}[{i}].{k}")} if isinstance(x, dict) else x for i, x in enumerate(items)]
        c = self.content
        if self.module == "D1.2":
            if isinstance(c.get("rulesOrSteps"), list):
                c["rulesOrSteps"] = trim(c["rulesOrSteps"], "rulesOrSteps", ("stepOrder",))
            if isinstance(c.get("preconditions"), list) and not any(p.startswith("$.preconditions[") for p in have):
                c["preconditions"] = []
            if isinstance(c.get("exceptions"), list):
                c["exceptions"] = [{k: v for k, v in x.items() if k != "handling" or f"$.exceptions[{i}].condition" not in have or under(f"$.exceptions[{i}].handling")} if isinstance(x, dict) else x for i, x in enumerate(c["exceptions"])]
        else:
            self.rebuild_strategy(c, have, under, trim)
        if json.dumps(c, sort_keys=True) != before:
            self.note("content", "parts without attribution taken out")

    def rebuild_strategy(self, c: dict, have: set[str], under, trim) -> None:
        acts = c.get("actions")
        if isinstance(acts, list) and acts:
            kept = [x for i, x in enumerate(acts) if under(f"$.actions[{i}]")]
            if kept and len(kept) != len(acts):
                c["actions"] = kept
            elif not kept:
                backed = [k for k in self.claims if k["kind"] in ("rule", "strategy") or set(k["attributes"]) & {"branch_yes", "branch_no"} or ({"condition", "action"} <= set(k["attributes"]) and any(w in k["statement"] for w in BRANCH_WORDS))]
                if backed:
                    c["actions"] = [k["statement"] for k in backed]
                    for i, k in enumerate(backed):
                        self.use(k["claim_id"], [f"$.actions[{i}]"], "primary")
            c["actions"] = trim(c["actions"], "actions", ())
        conditions = c.get("triggerConditions")
        if self.claims and isinstance(conditions, list) and sum(p.startswith("$.triggerConditions[") for p in have) < len(conditions):
            heads = {}
            for k in self.claims:
                lines = [line.lstrip("# \t").strip() for e in k["evidence"] for line in (e["source_text"] or "").splitlines() if line.lstrip().startswith("#") and line.lstrip("# \t").strip()]
                heads.setdefault(lines[0] if lines else k["subject"], k["claim_id"])
            c["triggerConditions"] = list(heads)
            for i, claim_id in enumerate(heads.values()):
                self.use(claim_id, [f"$.triggerConditions[{i}]"])
        if self.claims and "$.decisionLogic" not in have:
            c["decisionLogic"] = "；".join(k["statement"].rstrip("。；") for k in self.claims)
            for k in self.claims:
                self.use(k["claim_id"], ["$.decisionLogic"])

    def settle(self) -> None:
        """Usage of what is left, references to the claims in use, and links that lack their parts."""
        for u in self.usage:
            u["contentPaths"] = list(dict.fromkeys(p for p in u["contentPaths"] if self.spread(p)))
        self.usage = [u for u in self.usage if u["contentPaths"]]
        self.used = list(dict.fromkeys(u["claimId"] for u in self.usage))
        if "factReferences" in self.content and self.used:
            self.content["factReferences"] = self.used
        sources = self.used if self.has_usage else list(self.by_id)
        self.evidence = sorted({e["anchor_id"] for i in sources for e in self.by_id[i]["evidence"]})
        ok = [m for m in self.mentions if isinstance(m, dict) and m.get("sourceRef") in self.evidence]
        if len(ok) != len(self.mentions):
            self.note("entityMentions", f"{len(self.mentions) - len(ok)} removed")
        self.mentions = ok
        need = {"relationKind", "relationType", "sourceRef", "targetRef", "evidence"}
        ok = [r for r in self.relations if isinstance(r, dict) and need <= set(r)]
        if len(ok) != len(self.relations):
            self.note("relations", f"{len(self.relations) - len(ok)} removed")
        self.relations = ok
        if foreign := sorted({a for r in ok for a in r["evidence"] if isinstance(a, str)} - set(self.evidence)):
            self.issues.append("evidence not backed by source claims: " + ", ".join(foreign))
        for o in self.omitted:
            if o.get("claimId") in self.by_id and o["claimId"] not in self.used and isinstance(o.get("reason"), str) and len(o["reason"].strip()) > 1:
                self.unresolved.append((o["claimId"], o["reason"].strip()))
        self.unresolved = [(i, w) for i, w in self.unresolved if i not in self.used]
        if self.has_usage:
            self.unresolved += [(i, "planned for the object but not shown in its content") for i in self.by_id if i not in self.used and i not in {x for x, _ in self.unresolved}]
        if self.kind == "STANDARD_SCRIPT" and self.content.get("script") not in {e["source_text"] for i in sources for e in self.by_id[i]["evidence"] if self.by_id[i]["kind"] == "script"}:
            self.issues.append("the script must equal verified source text")

    def run(self) -> dict:
        for step in (self.shape, self.replace_highlights, self.backfill, self.objections, self.questions, self.check_usage, self.match_exactly, self.prune, self.settle):
            step()
        paths, have = [p for p, _ in walk(self.content, "$", SKIP, [])], self.attributed()
        gaps = sorted(critical(self.module, self.kind, self.content) - have) if self.has_usage else []
        return {
            "content": json.dumps(self.content, ensure_ascii=False, sort_keys=True), "evidence": self.evidence, "used_claims": self.used, "has_usage": self.has_usage,
            "usage": [{"claim_id": u["claimId"], "role": u["role"], "paths": u["contentPaths"]} for u in self.usage], "leaf_count": len(paths), "attributed_count": sum(p in have for p in paths),
            "unattributed": sorted(set(paths) - have), "quality_issues": ["critical content lacks attribution: " + "、".join(gaps)] if gaps else [],
            "mentions": [{"mention_id": str(m.get("mentionId")), "text": str(m.get("text") or ""), "type": m.get("proposedType"), "role": m.get("referenceRole"), "anchor": m.get("sourceRef")} for m in self.mentions],
            "relations": [{"kind": r["relationKind"], "type": r["relationType"], "source": r["sourceRef"], "target": r["targetRef"], "evidence": [a for a in r["evidence"] if isinstance(a, str)]} for r in self.relations],
            "unresolved": [{"claim_id": i, "reason": w} for i, w in self.unresolved], "notes": self.notes, "issues": self.issues,
        }


RESULT = "content string, evidence array<string>, used_claims array<string>, has_usage boolean, usage array<struct<claim_id string, role string, paths array<string>>>, leaf_count int, attributed_count int, unattributed array<string>, quality_issues array<string>, mentions array<struct<mention_id string, text string, type string, role string, anchor string>>, relations array<struct<kind string, type string, source string, target string, evidence array<string>>>, unresolved array<struct<claim_id string, reason string>>, notes array<string>, issues array<string>"


def realize(plans: DataFrame, claims: DataFrame, realizations: DataFrame, rules: RuleSet) -> DataFrame:
    """Candidates (plan columns, RESULT, and violations of the content's contract): a plan without realization is one with empty content; a realization
    (doc_id, plan_id, realization JSON) without plan is an invalid row."""
    one = realizations.groupBy("doc_id", "plan_id").agg(F.first("realization").alias("realization"))
    met = plans.join(one, ["doc_id", "plan_id"], "full_outer")
    gathered = links(plans, claims).groupBy("doc_id", "pos").agg(F.sort_array(F.collect_list(F.struct("nth", "claim_id", "claim_kind", "statement", "subject", "attributes", "evidence"))).alias("claims"))
    rich = met.join(gathered, ["doc_id", "pos"], "left").withColumn("claims", F.coalesce("claims", F.array().cast(gathered.schema["claims"].dataType)))
    rich = rich.withColumnRenamed("plan_id", "candidate_id")
    base = ["candidate_id" if c == "plan_id" else c for c in PLAN]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rich.select(base).schema) + ", " + RESULT
    names = T.StructType.fromDDL(RESULT).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                head = {c: row[c] for c in base}
                if not isinstance(row["module"], str):
                    rows.append(head | dict.fromkeys(names) | {"issues": ["realization without plan"]})
                    continue
                row["claims"] = [{**c, "evidence": [dict(e) for e in c["evidence"]]} for c in row["claims"]]
                rows.append(head | Work(row).run())
            yield pd.DataFrame(rows, columns=[*base, *names])

    made = with_violations(rich.mapInPandas(run, schema), rules)
    # a realization without plan has no type to be held against
    return made.withColumn("violations", F.when(F.col("module").isNull(), F.array().cast(made.schema["violations"].dataType)).otherwise(F.col("violations")))


def judge(candidates: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by classification, contract, and repeated ids or contents in a document. Candidates that were not held
    against contracts (no column `violations`) have no violations."""
    if "violations" not in candidates.columns:
        candidates = candidates.withColumn("violations", F.array().cast(f"array<{VIOLATION}>"))
    known = classification(rules, candidates)
    w = lambda *k: F.row_number().over(Window.partitionBy("doc_id", *k).orderBy(F.col("pos").asc_nulls_last())) > 1
    reasons = F.concat("class_issues", "issues", F.transform("violations", reason), F.array_compact(F.array(F.when(w("candidate_id"), F.lit("duplicate candidate id")), F.when(w("module", "object_type", "content"), F.lit("duplicate candidate content in the document")))))
    done = settle(known.withColumn("reasons", reasons).drop("class_issues"))
    return done.where(F.size("reasons") == 0).drop("reasons", "issues", "violations"), done.where(F.size("reasons") > 0)


def drop_dangling(accepted: DataFrame) -> DataFrame:
    """Relations whose ends are neither accepted candidates nor their mentions are taken out and counted."""
    ends = accepted.select("doc_id", F.col("candidate_id").alias("ref")).unionByName(accepted.select("doc_id", F.explode("mentions.mention_id").alias("ref"))).distinct()
    rel = accepted.select("doc_id", "candidate_id", F.posexplode("relations").alias("n", "r"))
    ends = ends.select(F.col("doc_id").alias("end_doc"), F.col("ref").alias("end"))
    for side in ("source", "target"):
        rel = rel.join(ends, (F.col("doc_id") == F.col("end_doc")) & (F.col(f"r.{side}") == F.col("end")), "left_semi")
    kept = rel.groupBy("doc_id", "candidate_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.to_json("r").alias("r")))), lambda x: F.from_json(x["r"], accepted.schema["relations"].dataType.elementType.simpleString())).alias("kept"))
    out = accepted.join(kept, ["doc_id", "candidate_id"], "left").withColumn("kept", F.coalesce("kept", F.array().cast(accepted.schema["relations"].dataType)))
    return settle(out.withColumn("dangling", F.size("relations") - F.size("kept")).withColumn("relations", F.col("kept")).drop("kept"))


def unresolved(accepted: DataFrame, rejected: DataFrame, uncovered: DataFrame) -> DataFrame:
    """(doc_id, claim_id, reason): open claims, the first reason of each, without claims that some accepted content uses."""
    own = accepted.select("doc_id", F.lit(0).alias("rank"), "pos", F.explode("unresolved").alias("u")).select("doc_id", "rank", "pos", "u.claim_id", "u.reason")
    refused = rejected.select("doc_id", F.lit(1).alias("rank"), "pos", F.explode("claim_ids").alias("claim_id"), F.concat(F.lit("candidate rejected: "), F.array_join("reasons", "；")).alias("reason"))
    open_ = uncovered.select("doc_id", F.lit(2).alias("rank"), "pos", "claim_id", F.lit("no plan covers the claim").alias("reason"))
    used = accepted.select("doc_id", F.explode("used_claims").alias("claim_id")).distinct()
    rows = own.unionByName(refused).unionByName(open_).join(used, ["doc_id", "claim_id"], "left_anti")
    return rows.groupBy("doc_id", "claim_id").agg(F.min_by("reason", F.struct("rank", "pos")).alias("reason"))


def coverage(accepted: DataFrame, weak: DataFrame, open_items: DataFrame, rules: RuleSet) -> DataFrame:
    """Status of each module in each document: hit, weak_signal, unresolved or not_found, the strongest first."""
    spark = accepted.sparkSession
    facts = accepted.select("doc_id", "module", F.lit("hit").alias("status")).unionByName(weak.select("doc_id", "module", F.lit("weak_signal").alias("status"))).unionByName(open_items.select("doc_id", "module", F.lit("unresolved").alias("status"))).where("module is not null")
    key = facts.withColumn("key", F.concat_ws("|", "doc_id", "module"))
    dims = facts.select("doc_id").distinct().crossJoin(F.broadcast(rules.catalog(spark).select("module").distinct())).withColumn("key", F.concat_ws("|", "doc_id", "module"))
    best = priority_rollup(dims, key, "key", "status", ["hit", "weak_signal", "unresolved"], "not_found")
    return dims.join(best, "key").drop("key")


def auxiliary(items: DataFrame, anchors: DataFrame, modules: list[str] | None = None, kind: str = "unresolved_item") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) weak signals or open items (doc_id, pos, description, reason, evidence, and module where `modules`
    are given): their texts, known modules and known anchors. A weak signal needs a module and evidence but no description."""
    known = anchors.groupBy("doc_id").agg(F.collect_set("anchor_id").alias("known"))
    met = items.join(known, "doc_id", "left")
    lacks = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    weak = F.lit(kind == "weak_signal")
    odd_module = F.lit(False) if modules is None else F.coalesce(~F.col("module").isin(*modules), weak)
    tests = [(~weak & lacks("description"), "a description is required"), (lacks("reason"), "a reason is required"), (odd_module, "the module is unknown"), (weak & (F.coalesce(F.size("evidence"), F.lit(0)) < 1), "evidence is required"), (F.size(F.array_except("evidence", F.coalesce("known", F.array().cast("array<string>")))) > 0, "evidence names an unknown anchor")]
    done = met.withColumn("issues", F.array_compact(F.array(*[F.when(test, words) for test, words in tests]))).drop("known")
    return done.where(F.size("issues") == 0).drop("issues"), done.where(F.size("issues") > 0)


def repairable(rejected: DataFrame, calls: DataFrame, most: int = 4) -> DataFrame:
    """Rejected candidates worth one more realization: every reason is a content violation that writing it again can mend,
    and the document made fewer calls (doc_id, a row each) than `most`."""
    few = calls.groupBy("doc_id").count().where(F.col("count") < most).select("doc_id")
    about = (F.size("violations") > 0) & (F.size("reasons") == F.size("violations")) & F.forall("violations", lambda v: v["kind"].isin(*REPAIRABLE))
    return rejected.where(about).join(few, "doc_id", "left_semi")


def content_leaves(candidates: DataFrame) -> DataFrame:
    """(doc_id, candidate_id, path, value, attributed) of each leaf of the content."""
    flat = candidates.select("doc_id", "candidate_id", F.explode(leaves(F.col("content"))).alias("l"), F.flatten("usage.paths").alias("have"))
    return flat.select("doc_id", "candidate_id", "l.path", "l.value", F.array_contains("have", F.col("l.path")).alias("attributed"))
