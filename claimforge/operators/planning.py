"""Object plans: batches, rule-table validation, guards that restore omitted duties, and granularity.

A plan is a row (doc_id, pos, plan_id, title, domain, module, object_type, identity_hints JSON, claim_ids).
Rules look at facts that one join of plans with their claims has gathered, and are rows of a table themselves.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from claimforge.functions.json_ops import has_any_key, is_empty_json
from claimforge.functions.text import casefold, contains_any, evidence_text, first_heading, let, same_text_key, strip_space
from claimforge.operators.relational import greedy_batches
from claimforge.rules import RuleSet
from claimforge.scratch import settle

# Markers and keys that the planning rules test.
GLOSSARY = ("术语", "词汇", "名词解释", "定义")
VAGUE_TIME = ("当前", "培训材料", "发布时", "未明确", "未知")
OMITTED = ("详见", "示例", "仅列举")
ALL_VERSIONS = ("全版本", "所有版本", "两个版本", "各版本", "通用")
NO_VERSION = ("当前版本", "未明确版本", "未知版本")
UNKNOWN_VERSION = ("未明确", "未知", "需核实")
ADVISORY, FORMAL = ("可能", "建议", "重试"), ("规定", "必须", "不得", "不能", "无法", "允许", "采用")
TEMPLATE = ("按照范本", "按范本", "按照标准话术", "按标准话术", "使用标准话术")
RESEARCH_KEYS = ("researchSource", "sampleSize", "sourceDate", "methodology")
SUPPORT_KEYS = ("rootConcern", "rootCause", "response", "responseContext", "resolution", "handling")
ACTION_KEYS = ("actions", "branches", "decisionLogic", "condition", "action")
SCRIPT_KEYS = ("script", "wording", "response", "verbatim")
SCOPE_KEYS = ("scope", "applicability", "applicableVersions")
POLICY_KEYS = ("restrictionScope", "condition", "action", "outcome", "allowed", "prohibited", "requirement")
NEED_TYPES = ("CUSTOMER_NEED", "PAIN_POINT", "PURCHASE_MOTIVATION", "URGENCY_RULE", "PERSUASION_TRIGGER", "TRUST_TRIGGER", "REJECTION_TRIGGER", "RESPONSE_PATTERN")
PRODUCT_TYPES = ("PRODUCT_FACT", "PRODUCT_VERSION_FACT", "PRODUCT_COMPONENT_FACT")
PRIMARY_KINDS = {"SALES_STRATEGY": ("strategy",), "DECISION_RULE": ("strategy", "rule"), "STANDARD_SCRIPT": ("script",), "CUSTOMER_OBJECTION": ("objection",), "QA_PAIR": ("qa",)}
PLAN = ["doc_id", "pos", "plan_id", "title", "domain", "module", "object_type", "identity_hints", "claim_ids"]


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("plan_id", "title", "module", "object_type", "identity_hints")] + [T.StructField("claim_ids", T.ArrayType(T.StringType())), T.StructField("issues", T.ArrayType(T.StringType()))]))
def parse_plan(raw: pd.Series, index: pd.Series) -> pd.DataFrame:
    """A raw plan object, or a compact array of six elements."""
    out = []
    for text, i in zip(raw, index):
        try:
            p = json.loads(text)
        except (TypeError, ValueError):
            p = None
        if isinstance(p, list) and len(p) == 6:
            p = dict(zip(("planId", "title", "module", "objectType", "identityHints", "sourceClaimIds"), p))
        if not isinstance(p, dict):
            out.append((f"INVALID-{i}", None, None, None, None, [], ["object plan must be a JSON object"]))
            continue
        hints, ids = p.get("identityHints"), p.get("sourceClaimIds")
        issues = [f"{k} must be a text" for k in ("title", "module", "objectType") if not isinstance(p.get(k), str)]
        if not isinstance(ids, list) or not all(isinstance(x, str) for x in ids):
            issues.append("sourceClaimIds must be a list of texts")
            ids = []
        out.append((str(p.get("planId", p.get("candidateId", f"INVALID-{i}"))), p.get("title"), p.get("module"), p.get("objectType"), json.dumps(hints if isinstance(hints, dict) else {}, ensure_ascii=False, sort_keys=True), ids, issues))
    return pd.DataFrame(out, columns=["plan_id", "title", "module", "object_type", "identity_hints", "claim_ids", "issues"])


def planning_batches(claims: DataFrame, limit: int = 45) -> DataFrame:
    """`claims` with `batch`: an anchor's claims stay together; a batch exceeds the limit only for one anchor."""
    one = claims.withColumn("anchor", F.coalesce(F.get(F.col("evidence"), F.lit(0))["anchor_id"], "claim_id"))
    groups = one.groupBy("doc_id", "anchor").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    dealt = greedy_batches(groups, ["doc_id"], ["first", "anchor"], "n", limit).select("doc_id", "anchor", "batch")
    return one.join(dealt, ["doc_id", "anchor"])


def branch(c: str = "") -> Column:
    """A claim that branches a sales conversation."""
    a, s = F.col(f"{c}attributes"), F.col(f"{c}statement")
    return has_any_key(a, ("branch_yes", "branch_no")) | (has_any_key(a, ("condition",)) & has_any_key(a, ("action",)) & contains_any(s, ("客户", "异议", "授权", "沟通")))


def reusable_script() -> Column:
    quotes = F.array_join(F.transform("evidence", lambda e: strip_space(e["exact_quote"])), " ")
    return ((F.col("claim_kind") == "script") | has_any_key(F.col("attributes"), SCRIPT_KEYS)) & ~(contains_any(quotes, TEMPLATE) & (F.length(quotes) < 80))


def heading() -> Column:
    return first_heading(F.col("evidence.source_text"), F.col("subject"))


def links(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, plan pos, nth, claim …) for the claims of each plan."""
    named = claims.select("doc_id", "claim_id", "claim_kind", "statement", "subject", "attributes", "evidence", F.col("pos").alias("claim_pos"))
    return plans.select("doc_id", "pos", "module", "object_type", F.posexplode("claim_ids").alias("nth", "claim_id")).join(named, ["doc_id", "claim_id"])


def home(rules: RuleSet, module: Column, branches: Column, scoped: Column) -> Column:
    """Whether a module is a primary home of a claim (its kind, whether it branches a conversation, whether it states a scope)."""
    by_prefix = F.exists(F.coalesce(F.element_at(rules.homes(), F.col("claim_kind")), F.array().cast("array<string>")), lambda p: F.startswith(module, p))
    return F.coalesce(by_prefix, F.lit(False)) | ((module == "D3.2") & branches) | (scoped & module.isin("D4.1", "D4.2", "D4.3"))


def scoped() -> Column:
    """A fact that states where it holds."""
    return (F.col("claim_kind") == "fact") & has_any_key(F.col("attributes"), SCOPE_KEYS)


def held(plans: DataFrame, claims: DataFrame, *columns: str) -> DataFrame:
    """`columns` of each plan beside each of its claims, with the columns that `claims` has. Rows are as narrow as the caller makes them:
    what a rule tests of a claim is best tested before, so that truth values are shuffled and no texts."""
    return plans.select("doc_id", *columns, F.explode("claim_ids").alias("claim_id")).join(claims, ["doc_id", "claim_id"])


def covers(plans_claims: DataFrame, rules: RuleSet) -> DataFrame:
    """Links at which the plan's module is a primary home of the claim's kind."""
    return plans_claims.groupBy("doc_id", "pos", "claim_id").agg(F.max(home(rules, F.col("module"), branch(), scoped())).alias("primary"))


def attach(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Plans with the claims that belong to them: support at an objection's anchors, scripts at a strategy's, all questions
    for a question plan, scope facts for D4; then only primary kinds and what shares an anchor with them."""
    flat = claims.select("doc_id", "claim_id", "claim_kind", "attributes", F.col("pos").alias("claim_pos"), F.explode(F.array_distinct("evidence.anchor_id")).alias("anchor")).cache()
    head = plans.select("doc_id", "pos", "module", "object_type")
    own = plans.select("doc_id", "pos", "module", "object_type", F.posexplode("claim_ids").alias("nth", "claim_id"))
    at = own.join(flat, ["doc_id", "claim_id"]).cache()
    pick = ["doc_id", "pos", "claim_id", "phase", "nth"]
    to = lambda on, kinds, phase: at.where(on).select("doc_id", "pos", "anchor").distinct().join(flat.where(kinds), ["doc_id", "anchor"]).select("doc_id", "pos", "claim_id", F.lit(phase).alias("phase"), F.col("claim_pos").alias("nth"))
    found = own.select("doc_id", "pos", "claim_id", F.lit(0).alias("phase"), "nth")
    found = found.unionByName(to(F.col("object_type") == "CUSTOMER_OBJECTION", F.col("claim_kind").isin("strategy", "script"), 1))
    found = found.unionByName(to(F.col("object_type").isin("SALES_STRATEGY", "DECISION_RULE") & (F.col("claim_kind") == "strategy"), F.col("claim_kind") == "script", 2))
    questions = head.where("module = 'D4.2' and object_type = 'QA_PAIR'").join(flat.where("claim_kind = 'qa'").select("doc_id", "claim_id", "claim_pos").distinct(), "doc_id")
    found = found.unionByName(questions.select("doc_id", "pos", "claim_id", F.lit(3).alias("phase"), F.col("claim_pos").alias("nth"))).select(*pick).cache()
    told = found.select("doc_id", "pos", "claim_id").distinct().join(head, ["doc_id", "pos"]).join(flat, ["doc_id", "claim_id"]).cache()
    scope = told.where(F.col("module").isin("D4.1", "D4.2", "D4.3")).select("doc_id", "pos", "anchor").distinct().join(flat.where((F.col("claim_kind") == "fact") & has_any_key(F.col("attributes"), SCOPE_KEYS)), ["doc_id", "anchor"])
    scope = scope.select("doc_id", "pos", "claim_id", F.lit(4).alias("phase"), F.col("claim_pos").alias("nth")).distinct()
    kinds = plans.sparkSession.createDataFrame([(t, k) for t, ks in PRIMARY_KINDS.items() for k in ks], "object_type string, claim_kind string")
    main = told.join(F.broadcast(kinds), ["object_type", "claim_kind"], "left_semi").select("doc_id", "pos", "claim_id", "anchor").cache()
    near = main.select("doc_id", "pos", "anchor").distinct()
    bound = main.select("doc_id", "pos").distinct().withColumn("bound", F.lit(True))
    every = found.unionByName(scope).groupBy("doc_id", "pos", "claim_id").agg(F.min(F.struct("phase", "nth")).alias("order"))
    close = flat.select("doc_id", "claim_id", "anchor").join(near, ["doc_id", "anchor"]).select("doc_id", "pos", "claim_id").unionByName(main.select("doc_id", "pos", "claim_id")).distinct().withColumn("close", F.lit(True))
    kept = every.join(bound, ["doc_id", "pos"], "left").join(close, ["doc_id", "pos", "claim_id"], "left").where("bound is null or close")
    lists = kept.groupBy("doc_id", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("order", "claim_id"))), lambda x: x["claim_id"]).alias("ids"))
    return plans.join(lists, ["doc_id", "pos"], "left").withColumn("claim_ids", F.coalesce("ids", F.array().cast("array<string>"))).drop("ids")


def facts(plans: DataFrame, claims: DataFrame, rules: RuleSet) -> DataFrame:
    """Plans with what the rules test about their claims, gathered in one aggregation."""
    is_ = lambda kind: F.col("claim_kind") == kind
    sized = lambda name: F.coalesce(F.json_array_length(F.get_json_object("attributes", f"$.{name}")) >= 2, F.lit(False))
    source = F.array_join(F.col("evidence.source_text"), "\n")
    scope = F.replace(F.concat_ws(" ", "statement", "attributes", F.array_join(F.col("evidence.exact_quote"), " ")), F.lit(" "), F.lit(""))
    told = {
        "omits": contains_any(source, OMITTED), "glossary": contains_any(heading(), GLOSSARY), "research": has_any_key(F.col("attributes"), RESEARCH_KEYS),
        "supported": F.col("claim_kind").isin("strategy", "script") | has_any_key(F.col("attributes"), SUPPORT_KEYS), "script": reusable_script(),
        "acts": has_any_key(F.col("attributes"), ACTION_KEYS), "every_version": contains_any(scope, ALL_VERSIONS), "branches": branch(), "scoped": scoped(),
        "sequence": sized("steps") | sized("actions") | sized("rulesOrSteps") | (F.size("evidence") >= 2) | F.coalesce(F.get_json_object("attributes", "$.answerType") == "process", F.lit(False)) | F.exists("evidence", lambda e: F.length(e["exact_quote"]) - F.length(F.replace(e["exact_quote"], F.lit("→"), F.lit(""))) >= 2),
        "advises": contains_any(F.col("statement"), ADVISORY), "formal": contains_any(F.col("statement"), FORMAL),
    }
    narrow = claims.select("doc_id", "claim_id", "claim_kind", *[v.alias(k) for k, v in told.items()])
    counts = {"n_known": F.count(F.lit(1))} | {f"n_{kind}": F.count_if(is_(kind)) for kind in ("list", "method", "term", "strategy", "process")}
    flags = {k: (F.min if k == "every_version" else F.max)(k) for k in told if k != "scoped"} | {"any_primary": F.max(home(rules, F.col("module"), F.col("branches"), F.col("scoped")))}
    gathered = held(plans, narrow, "pos", "module").groupBy("doc_id", "pos").agg(*[v.alias(k) for k, v in (counts | flags).items()])
    out = plans.join(gathered, ["doc_id", "pos"], "left")
    return out.fillna(0, list(counts)).fillna(False, list(flags))


def rule_table() -> list[tuple[str, Column]]:
    """(reason, condition under which a plan is rejected for it)."""
    kind, module = F.col("object_type"), F.col("module")
    product = (module == "D1.1") & kind.isin(*PRODUCT_TYPES)
    strategy = (module == "D3.2") & kind.isin("SALES_STRATEGY", "DECISION_RULE")
    version = F.replace(F.coalesce(F.get_json_object("identity_hints", "$.versionScope"), F.lit("未知")), F.lit(" "), F.lit(""))
    effective = F.coalesce(F.get_json_object("identity_hints", "$.effectiveTime"), F.lit(""))
    some = F.col("n_known") > 0
    return [
        ("the list's source points to members that it omits", (kind == "LIST_FACT") & F.col("omits")),
        ("a term object needs a glossary of several terms", (kind == "TERM") & ((F.col("n_term") < 2) | ~F.col("glossary"))),
        ("a comparison needs an explicit effective date", (kind == "COMPARISON_SNAPSHOT") & contains_any(effective, VAGUE_TIME)),
        ("a need or behaviour signal needs research metadata", (module == "D2.2") & kind.isin(*NEED_TYPES) & ~F.col("research")),
        ("the objection lacks a sourced root concern or response", (kind == "CUSTOMER_OBJECTION") & ~F.col("supported")),
        ("no reusable script text in the source", (kind == "STANDARD_SCRIPT") & ~F.col("script")),
        ("a technique needs a sourced method", (module == "D3.2") & kind.isin("SALES_TECHNIQUE", "METHOD_STEP", "APPLICABILITY_CONDITION") & (F.col("n_method") == 0)),
        ("a strategy needs more than operating methods", strategy & some & (F.col("n_method") == F.col("n_known"))),
        ("a strategy needs sourced actions or branches", strategy & (F.col("n_strategy") > 0) & ~F.col("acts")),
        ("an all-versions fact needs that scope on every claim", product & contains_any(version, ALL_VERSIONS) & ~F.col("every_version")),
        ("a product fact needs a known version", product & contains_any(version, UNKNOWN_VERSION)),
        ("conversation branches belong to D3.2", (kind == "BUSINESS_PROCESS") & F.col("branches")),
        ("a process needs a sourced sequence of steps", (kind == "BUSINESS_PROCESS") & ~(((F.col("n_known") >= 2) & (F.col("n_process") > 0)) | F.col("sequence"))),
        ("advice is no formal rule", (kind == "POLICY_RULE_SET") & F.col("advises") & ~F.col("formal")),
        ("an enumeration is no action rule", (module == "D3.2") & some & (F.col("n_list") == F.col("n_known"))),
        ("D3.2 needs a sourced strategy or decision rule", (module == "D3.2") & some & (F.col("n_list") < F.col("n_known")) & ~F.col("any_primary")),
        ("a title is required", F.coalesce(strip_space(F.col("title")) == "", F.lit(True))),
        ("identity hints are required", is_empty_json(F.col("identity_hints"))),
    ]


def classification(rules: RuleSet, df: DataFrame) -> DataFrame:
    """`df` with `class_issues`: unknown module, other domain, type not of the module, or a type for items only."""
    types = rules.catalog(df.sparkSession).select("object_type", F.col("module").alias("home"), "item_only")
    modules = rules.catalog(df.sparkSession).groupBy(F.col("module").alias("known")).agg(F.first("domain").alias("its_domain"))
    joined = df.join(F.broadcast(types), "object_type", "left").join(F.broadcast(modules), df["module"] == F.col("known"), "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), F.concat_ws("", F.lit("unknown module: "), "module")),
            F.when(F.col("its_domain") != F.col("domain"), F.lit("the domain isn't the module's")),
            F.when(F.col("home").isNull() | (F.col("home") != F.col("module")), F.concat_ws("", F.lit("object type not allowed in the module: "), "object_type")),
            F.when(F.col("item_only"), F.lit("the object type exists only as an item")),
        )
    )
    return joined.withColumn("class_issues", issues).drop("home", "item_only", "known", "its_domain")


def identity_missing(rules: RuleSet, df: DataFrame) -> DataFrame:
    """`df` with `missing_identity` (fields absent or empty) and `identity_json` (the identity fields, in order)."""
    field = lambda v, f: F.struct(F.lit(f).alias("field"), F.to_json(F.try_variant_get(v, f"$.{f}", "variant")).alias("text"))
    types: dict[tuple, list] = {}
    for kind, _, _, fields, _ in rules.contracts:
        types.setdefault(tuple(fields), []).append(kind)

    def named(v: Column) -> Column:
        out = F.array().cast("array<struct<field string, text string>>")
        for fields, kinds in types.items():
            out = F.when(F.col("object_type").isin(kinds), F.array(*[field(v, f) for f in fields])).otherwise(out) if fields else out
        return out

    # hints are parsed once, and the paths of fields once for all rows
    told = df.withColumn("__named", let(F.try_parse_json("identity_hints"), named))
    told = told.withColumn("missing_identity", F.transform(F.filter("__named", lambda x: is_empty_json(x["text"])), lambda x: x["field"]))
    return told.withColumn("identity_json", F.array_join(F.transform("__named", lambda x: F.coalesce(x["text"], F.lit("null"))), ",")).drop("__named")


def validate_plans(raw: DataFrame, claims: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of raw plans (doc_id, pos, raw); ids and identities count as used even by rejected plans."""
    parsed = raw.withColumn("p", parse_plan("raw", "pos")).select("doc_id", "pos", "raw", "p.*").withColumn("domain", F.split_part("module", F.lit("."), F.lit(1)))
    version = F.replace(F.coalesce(F.get_json_object("identity_hints", "$.versionScope"), F.lit("")), F.lit(" "), F.lit(""))
    named = F.contains(version, F.lit("版")) & ~contains_any(version, ALL_VERSIONS + NO_VERSION)
    parsed = parsed.withColumn("object_type", F.when((F.col("object_type") == "PRODUCT_FACT") & named, "PRODUCT_VERSION_FACT").otherwise(F.col("object_type")))
    tested = identity_missing(rules, classification(rules, facts(settle(attach(settle(parsed), claims)), claims, rules)))
    tested = settle(tested)
    sole = links(tested, claims).where("object_type = 'CUSTOMER_OBJECTION' and claim_kind = 'objection'").groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.first(F.coalesce(F.nullif(strip_space(F.get_json_object("attributes", "$.expression")), F.lit("")), strip_space(F.col("subject")))).alias("intent")).where("n = 1").drop("n")
    tested = tested.join(sole, ["doc_id", "pos"], "left").withColumn("identity_json", F.when(F.col("intent").isNotNull(), F.concat_ws(",", F.to_json(F.array("intent")), F.get_json_object("identity_hints", "$.context"))).otherwise(F.col("identity_json")))
    tested = tested.withColumn("unknown", F.size("claim_ids") - F.col("n_known"))
    shaped = F.size("issues") == 0
    w = lambda *k: F.row_number().over(Window.partitionBy("doc_id", shaped, *k).orderBy("pos")) > 1
    whole = shaped & (F.size("missing_identity") == 0)
    tested = tested.withColumn("same_id", shaped & w("plan_id")).withColumn("same_identity", whole & (F.row_number().over(Window.partitionBy("doc_id", whole, "module", "object_type", casefold(F.col("identity_json"))).orderBy("pos")) > 1))
    conditions = rule_table() + [("unknown source claim ids", F.col("unknown") > 0), ("duplicate object plan id", F.col("same_id")), ("duplicate object identity in the document", F.col("same_identity"))]
    found = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in conditions]))
    missing = F.transform("missing_identity", lambda f: F.concat(F.lit("missing identity field: "), f))
    done = tested.withColumn("reasons", F.when(shaped, F.concat("class_issues", found, missing)).otherwise(F.col("issues")))
    done = settle(done)
    return done.where(F.size("reasons") == 0).select(*PLAN), done.where(F.size("reasons") > 0).select("doc_id", "pos", "plan_id", "reasons", "raw")


def uncovered(plans: DataFrame, claims: DataFrame, rules: RuleSet, accounted: DataFrame | None = None) -> DataFrame:
    """Claims that no accepted plan covers and that the model didn't account for."""
    homes = plans.select("doc_id", "module", F.explode("claim_ids").alias("claim_id")).groupBy("doc_id", "claim_id").agg(F.collect_set("module").alias("__modules"))
    marked = claims.withColumn("__branches", branch()).withColumn("__scoped", scoped()).join(homes, ["doc_id", "claim_id"], "left")
    primary = F.coalesce(F.exists("__modules", lambda m: home(rules, m, F.col("__branches"), F.col("__scoped"))), F.lit(False))
    # rows of one id are covered together; they lie together after the join
    judged = marked.withColumn("__primary", primary).withColumn("__primary", F.max("__primary").over(Window.partitionBy("doc_id", "claim_id")))
    rest = judged.where("not __primary").select(*claims.columns)
    return rest if accounted is None else rest.join(accounted.select("doc_id", "claim_id").distinct(), ["doc_id", "claim_id"], "left_anti")


# Words of the titles and hints that guards and merges give to plans.
SAID = {
    "source_scene": "来源资料适用场景",
    "whole_text": "完整原文复用",
    "value_domain": "等值域",
    "dimension": "维度",
    "stable_values": "来源资料明确的稳定分类值域",
    "glossary": "资料术语与标准解释",
    "inner_context": "来源资料明确的内部业务语境",
    "rule_set": "规则集",
    "regulates": "规范",
    "constraint_scope": "来源资料明确的业务约束范围",
    "response_rule": "销售应对规则",
    "talk_scene": "来源资料适用销售沟通场景",
    "objection": "客户异议：",
    "version_theme": "产品版本综合事实",
    "version_fact": "产品版本事实",
    "value_set": "客户价值主张集",
    "provider_profile": "服务商能力档案",
    "current_service": "当前服务能力",
    "provider_theme": "服务商综合能力",
    "business_scope": "来源资料明确的业务范围",
    "value_hints": '{"customerValue":"六大客户价值主张","factScope":"来源资料中的同一产品","triggerContext":"来源资料未明确"}',
}


def _guard(grouped: DataFrame, prefix: str, module: str, kind: str, title: Column, hints: dict[str, Column]) -> DataFrame:
    identity = F.to_json(F.struct(*[v.alias(k) for k, v in hints.items()]))
    return grouped.select("doc_id", F.lit(None).cast("int").alias("pos"), F.concat(F.lit(prefix), F.get("ids", F.lit(0))).alias("plan_id"), title.alias("title"), F.lit(module.split(".")[0]).alias("domain"), F.lit(module).alias("module"), F.lit(kind).alias("object_type"), identity.alias("identity_hints"), F.col("ids").alias("claim_ids"))


def _gather(claims: DataFrame, *keys: str) -> DataFrame:
    """Claims grouped in order: their ids, and the first one's subject and heading."""
    g = claims.groupBy("doc_id", *keys).agg(F.sort_array(F.collect_list(F.struct("pos", "claim_id", "subject"))).alias("m"), F.min_by(heading(), "pos").alias("heading"))
    return g.withColumn("ids", F.array_distinct("m.claim_id")).withColumn("subject", F.get("m.subject", F.lit(0)))


def _used(plans: DataFrame, condition: str) -> DataFrame:
    return plans.where(condition).select("doc_id", F.explode("claim_ids").alias("claim_id")).distinct()


def guard_scripts(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Plans for reusable scripts that no script plan holds, by goal and audience."""
    left = claims.where(reusable_script()).join(_used(plans, "object_type = 'STANDARD_SCRIPT'"), ["doc_id", "claim_id"], "left_anti")
    given = lambda k: F.nullif(strip_space(F.get_json_object("attributes", f"$.{k}")), F.lit(""))
    left = left.withColumn("goal", F.coalesce(given("communicationGoal"), "subject")).withColumn("audience", F.coalesce(given("audience"), F.lit(SAID["source_scene"])))
    return _guard(_gather(left, "goal", "audience"), "guard-D42-", "D4.2", "STANDARD_SCRIPT", F.col("subject"), {"communicationGoal": F.col("goal"), "method": F.lit(SAID["whole_text"]), "applicability": F.col("audience")})


def guard_dimensions(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Plans for value domains: two or more coded terms of one anchor outside any dimension plan."""
    terms = claims.where((F.col("claim_kind") == "term") & has_any_key(F.col("attributes"), ("code",)) & has_any_key(F.col("attributes"), ("meaning",))).withColumn("anchor", F.get("evidence.anchor_id", F.lit(0)))
    used = _used(plans, "object_type = 'PROFILE_DIMENSION'").withColumn("used", F.lit(1))
    fresh = terms.join(used, ["doc_id", "claim_id"], "left").groupBy("doc_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.count("used").alias("u")).where("n > 1 and u < n").select("doc_id", "anchor")
    name = F.coalesce(F.nullif(strip_space(F.regexp_replace("heading", r"^(知识点\s*\d+[:：]\s*)|(定义)$", "")), F.lit("")), F.concat("subject", F.lit(SAID["value_domain"])))
    return _guard(_gather(terms.join(fresh, ["doc_id", "anchor"], "left_semi"), "anchor"), "guard-D21-", "D2.1", "PROFILE_DIMENSION", F.concat(name, F.lit(SAID["dimension"])), {"dimensionName": name, "businessScope": F.lit(SAID["stable_values"])})


def guard_glossary(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """One plan for the terms under glossary headings that no plan of D2.1 or D4.1 holds, if they are two or more."""
    left = claims.where((F.col("claim_kind") == "term") & (F.size("evidence") > 0) & contains_any(heading(), GLOSSARY)).join(_used(plans, "module in ('D2.1', 'D4.1')"), ["doc_id", "claim_id"], "left_anti")
    g = _gather(left).where(F.size("ids") > 1)
    return _guard(g, "guard-D41-TERM-", "D4.1", "TERM", F.lit(SAID["glossary"]), {"subject": F.array_join("m.subject", "、"), "applicability": F.lit(SAID["inner_context"])})


def guard_policies(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Plans for two or more constraint rules that a strategy plan uses and no rule or process plan holds."""
    pc = links(plans.where("module = 'D3.2'"), claims)
    strategic = pc.where("claim_kind = 'strategy'").select("doc_id", "pos").distinct()
    free = pc.join(strategic, ["doc_id", "pos"], "left_semi").where((F.col("claim_kind") == "rule") & has_any_key(F.col("attributes"), POLICY_KEYS)).join(_used(plans, "object_type in ('POLICY_RULE_SET', 'BUSINESS_PROCESS')"), ["doc_id", "claim_id"], "left_anti")
    owner = free.groupBy("doc_id", "claim_id").agg(F.min("pos").alias("plan_pos"))
    g = _gather(claims.join(owner, ["doc_id", "claim_id"]), "plan_pos").where(F.size("ids") > 1)
    subject = F.coalesce(F.nullif(strip_space(F.regexp_replace("heading", r"^\d+[、.]\s*", "")), F.lit("")), "subject")
    return _guard(g, "guard-D13-", "D1.2", "POLICY_RULE_SET", F.concat(subject, F.lit(SAID["rule_set"])), {"purpose": F.concat(F.lit(SAID["regulates"]), subject), "subject": subject, "scope": F.lit(SAID["constraint_scope"])})


def guard_branches(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Decision rules for conversation branches outside D3.2, one for each source heading."""
    left = claims.where(branch() & (F.size("evidence") > 0)).join(_used(plans, "module = 'D3.2'"), ["doc_id", "claim_id"], "left_anti").withColumn("topic", heading())
    return _guard(_gather(left, "topic"), "guard-D33-CONVERSATION-", "D3.2", "DECISION_RULE", F.concat("topic", F.lit(SAID["response_rule"])), {"strategyGoal": F.array_join("m.subject", "；"), "triggerContext": F.col("topic"), "applicability": F.lit(SAID["talk_scene"])})


def guard_objections(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Plans for objections with a sourced response that no objection plan holds."""
    left = claims.where((F.col("claim_kind") == "objection") & has_any_key(F.col("attributes"), SUPPORT_KEYS)).join(_used(plans, "object_type = 'CUSTOMER_OBJECTION'"), ["doc_id", "claim_id"], "left_anti").withColumn("own", F.col("claim_id"))
    return _guard(_gather(left, "own"), "guard-D41-", "D4.1", "CUSTOMER_OBJECTION", F.concat(F.lit(SAID["objection"]), "subject"), {"objectionIntent": F.col("subject"), "context": F.lit(SAID["source_scene"])})


def with_guards(plans: DataFrame, claims: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """Plans and what the guards restore; new plans follow the old ones in position. Value domains count before glossaries.
    Branches and objections are restored from `left` (doc_id, claim_id: what repair left uncovered), from all claims where none is given."""
    open_claims = claims if left is None else claims.join(left.select("doc_id", "claim_id").distinct(), ["doc_id", "claim_id"], "left_semi")
    domains = guard_dimensions(plans, claims)
    new = guard_scripts(plans, claims).unionByName(domains).unionByName(guard_policies(plans, claims))
    for guard in (guard_branches, guard_objections):
        new = new.unionByName(guard(plans, open_claims))
    new = new.unionByName(guard_glossary(plans.select(*PLAN).unionByName(domains), claims))
    new = new.dropDuplicates(["doc_id", "plan_id"]).join(plans.select("doc_id", "plan_id"), ["doc_id", "plan_id"], "left_anti")
    top = plans.groupBy("doc_id").agg(F.max("pos").alias("top"))
    placed = new.join(top, "doc_id", "left").withColumn("pos", (F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id").orderBy("plan_id"))).cast(plans.schema["pos"].dataType))
    return settle(plans.select(*PLAN).unionByName(placed.select(*PLAN)))


def merge_plans(existing: DataFrame, repairs: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(merged, rejected): repairs whose id or identity the document already has are rejected."""
    key = lambda df: identity_missing(rules, df).withColumn("key", F.concat_ws("|", "module", "object_type", casefold(F.col("identity_json"))))
    old = key(existing)
    fresh = key(repairs).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("pos"))).withColumn("nth_id", F.row_number().over(Window.partitionBy("doc_id", "plan_id").orderBy("pos")))
    fresh = fresh.join(old.select("doc_id", "plan_id", F.lit(True).alias("same_id")).distinct(), ["doc_id", "plan_id"], "left").join(old.select("doc_id", "key", F.lit(True).alias("same")).distinct(), ["doc_id", "key"], "left")
    reasons = F.array_compact(F.array(F.when(F.col("same_id") | (F.col("nth_id") > 1), F.lit("duplicate repair plan id")), F.when(F.col("same") | (F.col("nth") > 1), F.lit("repair plan duplicates an existing object identity"))))
    fresh = fresh.withColumn("reasons", reasons)
    return existing.select(*PLAN).unionByName(fresh.where(F.size("reasons") == 0).select(*PLAN)), fresh.where(F.size("reasons") > 0).select("doc_id", "plan_id", "reasons")


def augment_plans(plans: DataFrame, additions: DataFrame, repair_claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, rejected) after appending claims. An addition (doc_id, nth, plan_id, claim_ids) is refused whole if its plan is
    unknown, if it has no claims, or if it names one that isn't among `repair_claims`; else if it would bring branches of a
    conversation into a plan of D1.2. Additions to one plan apply in the order of nth; a claim is there once."""
    rows = additions.select("doc_id", "nth", "plan_id", "claim_ids", F.explode_outer(F.array_distinct("claim_ids")).alias("claim_id"))
    known = repair_claims.select("doc_id", "claim_id", branch().alias("branches"), F.lit(True).alias("known"))
    met = rows.join(known, ["doc_id", "claim_id"], "left").groupBy("doc_id", "nth", "plan_id").agg(
        F.first("claim_ids").alias("claim_ids"),
        F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("claim_id")))).alias("unknown"),
        F.array_sort(F.collect_set(F.when(F.col("branches"), F.col("claim_id")))).alias("branching"),
    )
    homes = plans.select("doc_id", "plan_id", F.col("module").alias("home"), F.lit(True).alias("planned"))
    judged = met.join(homes, ["doc_id", "plan_id"], "left")
    basic = F.array_compact(
        F.array(
            F.when(F.col("planned").isNull(), "unknown plan"),
            F.when(F.coalesce(F.size("claim_ids") < 1, F.lit(True)), "no claims"),
            F.when(F.size("unknown") > 0, F.concat(F.lit("unknown claims: "), F.array_join("unknown", ", "))),
        )
    )
    foreign = F.when((F.col("home") == "D1.2") & (F.size("branching") > 0), F.array(F.concat(F.lit("conversation claims in a process plan: "), F.array_join("branching", ", ")))).otherwise(F.array().cast("array<string>"))
    judged = settle(judged.withColumn("basic", basic).withColumn("reasons", F.when(F.size("basic") > 0, F.col("basic")).otherwise(foreign)))
    good = judged.where("size(reasons) = 0").groupBy("doc_id", "plan_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "claim_ids"))), lambda x: x["claim_ids"])).alias("add"))
    out = plans.join(good, ["doc_id", "plan_id"], "left").withColumn("claim_ids", F.array_distinct(F.concat("claim_ids", F.coalesce("add", F.array().cast("array<string>")))))
    return out.select(*PLAN), judged.where("size(reasons) > 0").select("doc_id", "nth", "plan_id", "reasons")


def granularity(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Merge plans for one version, component or set of question anchors, and all plans of numbered highlights; split plans that
    join several processes, rules or objections."""
    hint = lambda k: F.get_json_object("identity_hints", f"$.{k}")
    scope = F.regexp_replace(strip_space(hint("versionScope")), "(适用语境|语境|场景|上下文)$", "")
    anchors = links(plans, claims).select("doc_id", "pos", F.explode("evidence").alias("e")).groupBy("doc_id", "pos").agg(F.array_join(F.sort_array(F.collect_set("e.anchor_id")), "|").alias("anchors"), F.max(F.col("e.source_text").rlike(r"亮点\s*\d+")).alias("numbered"))
    p = plans.join(anchors, ["doc_id", "pos"], "left")
    key = (
        F.when(F.col("object_type") == "PRODUCT_VERSION_FACT", F.concat_ws("|", F.lit("version"), casefold(strip_space(hint("subject"))), casefold(scope)))
        .when((F.col("object_type") == "SELLING_POINT") & F.col("numbered"), F.lit("value"))
        .when(F.col("object_type") == "PRODUCT_COMPONENT_FACT", F.concat_ws("|", F.lit("component"), casefold(strip_space(hint("subject")))))
        .when(F.col("object_type") == "QA_PAIR", F.concat_ws("|", F.lit("qa"), F.coalesce("anchors", "plan_id")))
    )
    keyed = p.withColumn("key", F.coalesce(key, F.concat(F.lit("own|"), "plan_id")))
    merged = keyed.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*PLAN[1:-1]), "pos").alias("p"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "claim_ids"))), lambda x: x["claim_ids"]))).alias("claim_ids"))
    kind, hints = F.split_part("key", F.lit("|"), F.lit(1)), F.col("p.identity_hints")
    several = F.col("n") > 1
    get = lambda k: F.get_json_object(hints, f"$.{k}")
    new_scope = F.regexp_replace(strip_space(get("versionScope")), "(适用语境|语境|场景|上下文)$", "")
    new_hints = F.when(several & (kind == "version"), F.to_json(F.struct(get("subject").alias("subject"), new_scope.alias("versionScope"), F.lit(SAID["version_theme"]).alias("factTheme")))).when(kind == "value", F.lit(SAID["value_hints"])).when(several & (kind == "component"), F.to_json(F.struct(get("subject").alias("subject"), F.lit(SAID["current_service"]).alias("versionScope"), F.lit(SAID["provider_theme"]).alias("factTheme")))).otherwise(hints)
    title = F.when(several & (kind == "version"), F.concat(get("subject"), new_scope, F.lit(SAID["version_fact"]))).when(kind == "value", F.lit(SAID["value_set"])).when(several & (kind == "component"), F.concat(get("subject"), F.lit(SAID["provider_profile"]))).otherwise(F.col("p.title"))
    plans = merged.select("doc_id", "p.pos", "p.plan_id", title.alias("title"), "p.domain", "p.module", "p.object_type", new_hints.alias("identity_hints"), "claim_ids")
    plans = settle(plans)
    pc = links(plans, claims).cache()
    pivot = F.when(F.col("object_type") == "BUSINESS_PROCESS", "process").when(F.col("object_type") == "POLICY_RULE_SET", "rule").when(F.col("object_type") == "CUSTOMER_OBJECTION", "objection")
    pivots = pc.where(F.col("claim_kind") == pivot).withColumn("anchor", F.get("evidence.anchor_id", F.lit(0)))
    spread = pivots.groupBy("doc_id", "pos", "object_type").agg(F.countDistinct(evidence_text(F.col("subject"))).alias("subjects"), F.countDistinct("anchor").alias("places"))
    cut = spread.where("subjects > 1 and (places > 1 or object_type = 'CUSTOMER_OBJECTION')").select("doc_id", "pos")
    heads = pivots.join(cut, ["doc_id", "pos"], "left_semi").groupBy("doc_id", "pos", "anchor").agg(F.min_by(F.struct("subject", "attributes"), "claim_pos").alias("h"))
    parts = pc.join(cut, ["doc_id", "pos"], "left_semi").select("doc_id", "pos", "nth", "claim_id", F.explode(F.array_distinct("evidence.anchor_id")).alias("anchor")).join(heads.select("doc_id", "pos", "anchor"), ["doc_id", "pos", "anchor"]).groupBy("doc_id", "pos", "anchor").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("nth", "claim_id"))), lambda x: x["claim_id"])).alias("ids"))
    split = plans.join(heads.join(parts, ["doc_id", "pos", "anchor"]), ["doc_id", "pos"])
    subject, att = F.col("h.subject"), lambda k, d: F.coalesce(F.get_json_object("h.attributes", f"$.{k}"), d)
    ident = F.when(F.col("object_type") == "CUSTOMER_OBJECTION", F.to_json(F.struct(subject.alias("objectionIntent"), F.coalesce(hint("context"), F.lit(SAID["source_scene"])).alias("context")))).otherwise(F.to_json(F.struct(att("purpose", subject).alias("purpose"), att("subject", subject).alias("subject"), att("scope", F.lit(SAID["business_scope"])).alias("scope"))))
    split = split.select("doc_id", "pos", F.concat_ws("-", "plan_id", "anchor").alias("plan_id"), F.when(F.col("object_type") == "CUSTOMER_OBJECTION", F.concat(F.lit(SAID["objection"]), subject)).otherwise(subject).alias("title"), "domain", "module", "object_type", ident.alias("identity_hints"), F.col("ids").alias("claim_ids"))
    return plans.join(cut, ["doc_id", "pos"], "left_anti").unionByName(split)


def granularity_metrics(plans: DataFrame, claims: DataFrame) -> DataFrame:
    """Objects, plans of one claim and their rate, mean claims, and anchors spread over several plans, for each document."""
    base = plans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.size("claim_ids") == 1).alias("single_claim"), F.round(F.avg(F.size("claim_ids")), 2).alias("mean_claims"))
    places = held(plans, claims.select("doc_id", "claim_id", F.array_distinct("evidence.anchor_id").alias("anchors")), "pos").select("doc_id", "pos", F.explode("anchors").alias("anchor"))
    at = places.groupBy("doc_id", "anchor").agg(F.min("pos").alias("least"), F.max("pos").alias("most")).where("least < most").groupBy("doc_id").agg(F.count(F.lit(1)).alias("split_anchors"))
    return base.join(at, "doc_id", "left").fillna(0, ["split_anchors"]).withColumn("single_claim_rate", F.round(F.col("single_claim") / F.col("objects"), 4))


def realization_batches(plans: DataFrame, size: int = 10) -> DataFrame:
    return plans.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1) / size).cast("int"))
