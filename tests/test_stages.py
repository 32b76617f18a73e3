"""Planning, candidates, evaluation, formation, projection and table changes on literal cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from claimforge.operators import candidates as C, dml, evaluation as Q, formation as M, planning as P, projection as R, relational as X
from claimforge.rules import RuleSet, render_contracts
from tests.standins import hashing_embedder

CLAIMS = "doc_id string, pos int, claim_id string, claim_kind string, statement string, subject string, attributes string, module_hints array<string>, evidence array<struct<anchor_id string, exact_quote string, selector string, source_text string>>"


def claim(pos, cid, kind, anchor, quote, source=None, **attributes):
    return ("d", pos, cid, kind, quote, f"subject {cid}", json.dumps(attributes, ensure_ascii=False), [], [(anchor, quote, None, source or quote)])


@pytest.fixture(scope="module")
def rules():
    return RuleSet.built_in()


@pytest.fixture(scope="module")
def claims(spark):
    rows = [
        claim(1, "o1", "objection", "A1", "太贵了", expression="太贵了", responseContext="可以分期"), claim(2, "s1", "strategy", "A1", "先共情再分期", action="分期"),
        claim(3, "q1", "qa", "A2", "怎么退", question="怎么退", answer="联系客服"), claim(4, "p1", "process", "A3", "登录 -> 提交", steps=["登录", "提交"]),
        claim(5, "f1", "fact", "A4", "等待期7天", source="# 等待期\n等待期7天"), claim(6, "t1", "term", "A5", "甲指乙", source="# 术语表\n甲指乙", code="1", meaning="x"), claim(7, "t2", "term", "A5", "丙指丁", source="# 术语表\n丙指丁", code="2", meaning="y"),
        claim(8, "x1", "script", "A6", "您好，欢迎了解"), claim(9, "q2", "qa", "A7", "多久到", question="多久到", answer="三天"),
    ]
    return spark.createDataFrame(rows, CLAIMS).cache()


def plan(pid, module, kind, ids, **hints):
    return json.dumps({"planId": pid, "title": pid, "module": module, "objectType": kind, "identityHints": hints, "sourceClaimIds": ids}, ensure_ascii=False)


RAW = [
    plan("ok", "D4.1", "CUSTOMER_OBJECTION", ["o1"], objectionIntent="价格", context="电话"),
    plan("qa", "D4.2", "QA_PAIR", ["q1"], subject="常见问题", applicability="全部"),
    plan("proc", "D1.2", "BUSINESS_PROCESS", ["p1"], purpose="投保", subject="流程", scope="全部"),
    plan("same", "D1.2", "BUSINESS_PROCESS", ["p1"], purpose="投保", subject="流程", scope="全部"),
    plan("noid", "D1.1", "PRODUCT_FACT", ["f1"], subject="产品"),
    plan("vague", "D1.1", "COMPARISON_SNAPSHOT", ["f1"], subjects="a", dimensionSet="b", effectiveTime="当前"),
    plan("named", "D1.1", "PRODUCT_FACT", ["f1"], subject="产品", versionScope="尊享版", factTheme="等待期"),
    plan("wrong", "D1.1", "QA_PAIR", ["q1"], subject="x", applicability="y"),
    plan("qa", "D4.2", "STANDARD_EXPLANATION", ["zz"], subject="x", applicability="y"),
    json.dumps(["term", "one term", "D4.1", "TERM", {"subject": "甲", "applicability": "内部"}, ["t1"]], ensure_ascii=False),
    "3",
]


@pytest.fixture(scope="module")
def planned(spark, claims, rules):
    raw = spark.createDataFrame([("d", i, r) for i, r in enumerate(RAW, 1)], "doc_id string, pos int, raw string")
    good, bad = P.validate_plans(raw, claims, rules)
    return good.cache(), {r["pos"]: (r["plan_id"], r["reasons"]) for r in bad.collect()}


def test_rules(spark, rules):
    assert rules.issues == [] and rules.catalog(spark).count() == 71 and rules.catalog(spark).where("not item_only").count() == 37
    assert rules.joined(spark).where("size(required_fields) = 0 or size(identity_fields) = 0").count() == 0
    assert "### D4.2" in render_contracts(rules, {"D4.2"}) and "### D1.1" not in render_contracts(rules, {"D4.2"})


def test_plans_are_judged(planned):
    good, bad = planned
    got = {r["plan_id"]: r for r in good.collect()}
    assert set(got) == {"ok", "qa", "proc", "named"}
    assert got["ok"]["claim_ids"] == ["o1", "s1"] and got["qa"]["claim_ids"] == ["q1", "q2"] and got["named"]["object_type"] == "PRODUCT_VERSION_FACT"
    assert "duplicate object identity in the document" in bad[4][1]
    assert bad[5][1] and any("missing identity field" in r for r in bad[5][1]) and "a comparison needs an explicit effective date" in bad[6][1]
    assert any("not allowed" in r for r in bad[8][1]) and {"unknown source claim ids", "duplicate object plan id"} <= set(bad[9][1])
    assert "a term object needs a glossary of several terms" in bad[10][1] and bad[11] == ("INVALID-11", ["object plan must be a JSON object"])


def test_guards_and_gaps(planned, claims, rules):
    good, _ = planned
    assert [r["claim_id"] for r in P.uncovered(good, claims, rules).orderBy("pos").collect()] == ["s1", "t1", "t2", "x1"]
    after = P.with_guards(good, claims)
    got = {r["plan_id"]: r for r in after.collect()}
    assert {"guard-D42-x1", "guard-D21-t1"} <= set(got) and got["guard-D21-t1"]["claim_ids"] == ["t1", "t2"]
    assert json.loads(got["guard-D21-t1"]["identity_hints"])["dimensionName"] == "术语表"
    assert not any(p.startswith("guard-D41-TERM") for p in got) and after.count() == len(got)
    merged, refused = P.merge_plans(good, good.limit(1), rules)
    assert merged.count() == good.count() and refused.count() == 1


def test_planning_batches(claims):
    got = P.planning_batches(claims, 2).select("claim_id", "batch").collect()
    by = {r["claim_id"]: r["batch"] for r in got}
    assert by["o1"] == by["s1"] == 0 and by["t1"] == by["t2"] and len(set(by.values())) == 5


def test_granularity(spark, claims, rules):
    rows = [("d", i, p, p, "D1", "D1.1", "PRODUCT_VERSION_FACT", json.dumps({"subject": s, "versionScope": v, "factTheme": p}), c) for i, (p, s, v, c) in enumerate([("a", "X", "尊享版", ["f1"]), ("b", "x", "尊享版适用语境", ["f1", "p1"]), ("c", "Y", "全能版", ["f1"])])]
    rows += [("d", 10, "m", "m", "D4", "D4.1", "CUSTOMER_OBJECTION", '{"context":"c"}', ["o1", "o2"])]
    plans = spark.createDataFrame(rows, "doc_id string, pos int, plan_id string, title string, domain string, module string, object_type string, identity_hints string, claim_ids array<string>")
    more = claims.unionByName(spark.createDataFrame([claim(20, "o2", "objection", "A9", "不需要", expression="不需要")], CLAIMS))
    got = {r["plan_id"]: r for r in P.granularity(plans, more).collect()}
    assert set(got) == {"a", "c", "m-A1", "m-A9"} and got["a"]["claim_ids"] == ["f1", "p1"] and json.loads(got["a"]["identity_hints"])["factTheme"] == "产品版本综合事实"
    assert got["m-A9"]["claim_ids"] == ["o2"]
    m = P.granularity_metrics(plans, more).first()
    assert (m["objects"], m["single_claim"], m["split_anchors"], m["single_claim_rate"]) == (4, 2, 1, 0.5)


@pytest.fixture(scope="module")
def judged(spark, planned, claims, rules):
    good, _ = planned
    answers = {
        "ok": {"planId": "ok", "content": {"objectionTheme": "价格", "expressions": ["invented"], "context": "电话", "rootConcernHypotheses": [], "resolutionElements": [{"element": "回应", "detail": "太贵了"}]}, "claimUsage": [{"claimId": "o1", "role": "primary", "contentPaths": ["$.expressions", "$.resolutionElements"]}], "entityMentions": [{"mentionId": "m1", "text": "公司 甲", "proposedType": "ORG", "referenceRole": "owner", "sourceRef": "A1"}, {"text": "bad", "sourceRef": "ZZ"}], "relations": [{"relationKind": "x", "relationType": "ABOUT", "sourceRef": "ok", "targetRef": "m1", "evidence": ["A1"]}, {"relationKind": "x", "relationType": "ABOUT", "sourceRef": "ok", "targetRef": "gone", "evidence": []}, "junk"]},
        "qa": {"planId": "qa", "content": {"items": [{"question": "怎么退", "answer": "联系客服", "claimRef": "q1"}], "factReferences": ["q1"], "applicability": "全部"}, "claimUsage": [{"claimId": "q1", "role": "primary", "contentPaths": ["$.items[0]"]}]},
        "proc": {"planId": "proc", "content": {"summary": "x"}},
        "lost": {"planId": "lost", "content": {}},
    }
    real = spark.createDataFrame([("d", k, json.dumps(v, ensure_ascii=False)) for k, v in answers.items()], "doc_id string, plan_id string, realization string")
    accepted, rejected = C.judge(C.realize(good, claims, real, rules), rules)
    return C.drop_dangling(accepted), rejected


def test_candidates(judged, planned, claims, rules):
    accepted, rejected = judged
    got = {r["candidate_id"]: r for r in accepted.collect()}
    assert set(got) == {"ok", "qa"}
    ok, qa = json.loads(got["ok"]["content"]), json.loads(got["qa"]["content"])
    assert ok["expressions"] == ["太贵了"] and ok["resolutionElements"][0]["detail"] == "可以分期"
    assert [i["claimRef"] for i in qa["items"]] == ["q1", "q2"] and got["qa"]["unattributed"] == ["$.applicability"]
    assert len(got["ok"]["mentions"]) == 1 and [r["target"] for r in got["ok"]["relations"]] == ["m1"] and got["ok"]["dangling"] == 1
    why = {r["candidate_id"]: r["reasons"] for r in rejected.collect()}
    assert any("summary" in r for r in why["proc"]) and any("missing required" in r for r in why["named"]) and "realization without plan" in why["lost"]
    open_ = {r["claim_id"]: r["reason"] for r in C.unresolved(accepted, rejected, P.uncovered(planned[0], claims, rules)).collect()}
    assert "s1" in open_ and "q1" not in open_ and open_["x1"] == "no plan covers the claim"
    cover = {r["module"]: r["status"] for r in C.coverage(accepted, accepted.select("doc_id", F.lit("D4.3").alias("module")), accepted.select("doc_id", F.lit("D4.1").alias("module")), rules).collect()}
    assert cover["D4.1"] == "hit" and cover["D4.3"] == "weak_signal" and cover["D5.2"] == "not_found" and len(cover) == 12


GROUPS = [
    {"key": "obj", "expectedCount": 1, "module": "D4.1", "objectTypes": ["CUSTOMER_OBJECTION"], "evidence": ["A1"], "requiredContentTerms": ["太贵"], "identityRules": {"objectionIntent": {"containsAny": ["价格"]}}},
    {"key": "items", "expectedCount": 1, "module": "D4.2", "objectTypes": ["QA_PAIR"], "requiredItemCount": 3},
    {"key": "miss", "expectedCount": 2, "module": "D1.1", "objectTypes": ["LIST_FACT"]},
    {"key": "ident", "expectedCount": 1, "module": "D4.2", "objectTypes": ["QA_PAIR"], "identityHints": {"subject": "other"}},
    {"key": "many", "expectedCount": 3, "minimumExpectedCount": 2, "maximumExpectedCount": 3, "module": "D4.1", "objectTypes": ["CUSTOMER_OBJECTION"]},
]


def test_gold(spark, judged, claims):
    accepted, _ = judged
    gold = {"status": "approved", "expectedObjectGroups": GROUPS, "negativeObjectGroups": [{"key": "never", "module": "D4.2", "objectTypes": ["QA_PAIR"]}, {"key": "open", "module": "D2.2", "objectTypes": ["PAIN_POINT"], "requiredUnresolvedEvidence": ["A6"]}]}
    df = spark.createDataFrame([("d", json.dumps(gold, ensure_ascii=False))], "doc_id string, gold string")
    opened = spark.createDataFrame([("d", "A6")], "doc_id string, anchor_id string")
    scored = Q.evaluate(Q.gold_groups(df), accepted, claims, opened).cache()
    got = {r["key"]: r["status"] for r in scored.collect()}
    # one candidate in two positive groups fails both
    assert got == {"obj": "contract_failed", "items": "contract_failed", "miss": "missed", "ident": "identity_failed", "many": "contract_failed", "never": "negative_hit", "open": "met"}
    stray = {(r["candidate_id"], r["kind"]) for r in Q.strays(scored, accepted).collect()}
    assert stray == {("qa", "forbidden")}
    packages = spark.createDataFrame([("d", "s", "m", ["a"])], "doc_id string, source_sha256 string, full_markdown_sha256 string, anchors array<string>")
    compat = Q.compatibility(df, {}, packages)
    rep = Q.report(scored, Q.strays(scored, accepted), accepted, claims, compat, df, opened)
    r = rep.first()
    assert r["overall_status"] == "fail" and r["expected"] == 8 and r["matched"] == 0 and r["claim_consumption_rate"] == round(3 / 9, 4) and r["claim_accounting_rate"] == round(4 / 9, 4)
    none = spark.createDataFrame([], "doc_id string, claim_id string")
    blockers = [b["blocker"] for b in Q.release_blockers(rep, spark.createDataFrame([("d", "r1")], "doc_id string, claim_id string"), df, none, none).collect()]
    assert "overall result is fail" in blockers and "1 source claims were rejected" in blockers
    alone = Q.evaluate(Q.gold_groups(spark.createDataFrame([("d", json.dumps({"expectedObjectGroups": GROUPS[:1]}))], "doc_id string, gold string")), accepted, claims, opened)
    assert alone.first()["status"] == "met" and alone.first()["matched_count"] == 1


STORED = "knowledge_object_id string, revision int, content_fingerprint string, title string, domain string, module string, object_type string, identity_key string, content string, evidence array<string>, file_path string, file_sha256 string"


def test_formation_and_projection(spark, judged, rules):
    accepted = judged[0].withColumn("workspace_id", F.lit("w"))
    lines = spark.createDataFrame([], "workspace_id string, source_lineage_key string, knowledge_object_id string")
    active = spark.createDataFrame([], "doc_id string, knowledge_object_id string")
    stored = spark.createDataFrame([], STORED)
    made = M.form(accepted, stored, lines, active, rules)
    first = {r["object_type"]: r for r in made["objects"].collect()}
    assert {r["action"] for r in first.values()} == {"created"} and made["verdict"].first()["status"] == ("completed" if accepted.where("size(quality_issues) > 0").count() == 0 else "review_required")
    assert all(k.startswith("KO-") and len(k) == 19 for k in (r["knowledge_object_id"] for r in first.values()))
    qa = first["QA_PAIR"]
    swapped = json.loads(qa["content"])
    swapped["items"] = swapped["items"][::-1]
    old = [(r["knowledge_object_id"], 3, "other", "T", r["domain"], r["module"], r["object_type"], "k", json.dumps(swapped, ensure_ascii=False) if r is qa else '{"objectionTheme":"old"}', list(r["evidence"]), "", "") for r in first.values()]
    stored = spark.createDataFrame(old, STORED)
    active = spark.createDataFrame([("d", r[0]) for r in old], "doc_id string, knowledge_object_id string")
    again = M.form(accepted, stored, lines, active, rules)
    now = {r["object_type"]: r for r in again["objects"].collect()}
    assert now["QA_PAIR"]["action"] == "reused" and now["QA_PAIR"]["revision"] == 3 and now["CUSTOMER_OBJECTION"]["action"] == "review_required"
    assert "$.objectionTheme" in now["CUSTOMER_OBJECTION"]["changed_paths"] and again["verdict"].first()["status"] == "review_required"
    ents = M.entities(made["mentions"], spark.createDataFrame([], "entity_id string"))
    assert [(r["canonical_name"], r["action"]) for r in ents.collect()] == [("公司 甲", "created")]
    rel = M.relationships(accepted, made["sources"], made["mentions"], made["objects"])
    assert [(r["type"], r["inverse_label"], r["target_kind"]) for r in rel.collect()] == [("ABOUT", "HAS_KNOWLEDGE", "business_entity")]
    text = M.render(made["objects"], rel).where(F.contains("markdown", F.lit("太贵了"))).first()
    assert text["markdown"].startswith("---\n") and "## relationships" in text["markdown"]
    units = R.retrieval_units(made["objects"])
    got = units.groupBy("content_path").count().collect()
    assert {r["content_path"] for r in got} == {"$.items[0]", "$.items[1]", "$"} and units.where("retrieval_text = '怎么退' and item_id = 'q1'").count() == 1
    nodes, edges = R.graph(made["objects"], ents, rel)
    assert edges.groupBy("type").count().count() == 3 and R.one_hop(edges, nodes, "d").where("entity_id is not null").count() == 1
    assert R.graph_sink(edges, edges.limit(0), "d").where("src = 'd'").count() == 0 and R.edges_around(edges, "d").count() == edges.count()
    assert R.isolated({"a": lambda: 1, "b": lambda: 1 / 0})["b"][0] == "failed"


def test_slots_and_fuzzy_matches(spark):
    a = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "k string, a long")
    b = spark.createDataFrame([("k1", 7), ("k2", 8)], "k string, b long")
    assert [tuple(r) for r in X.unique_slots(a, b, ["k"], "a", "b").collect()] == [(3, 8)]
    left = spark.createDataFrame([("x", 1, "药享保险"), ("x", 2, "abc")], "g string, a long, t string")
    right = spark.createDataFrame([("x", 7, "药享保"), ("x", 8, "zzz")], "g string, b long, t string")
    assert [(r["a"], r["b"]) for r in X.fuzzy_unique(left, right, ["g"], "a", "b", "t", 0.85).collect()] == [(1, 7)]
    both = right.unionByName(spark.createDataFrame([("x", 9, "药享保险")], right.schema))
    assert X.fuzzy_unique(left, both, ["g"], "a", "b", "t", 0.85).count() == 0


def test_commit_and_store(spark, tmp_path):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    obj, src = "knowledge_object_id string, status string, created_at int", "knowledge_object_id string, document_package_id string, run_id string, candidate_id string, active boolean"
    rel, rsrc = "relationship_id string, status string", "relationship_id string, document_package_id string, run_id string, active boolean"
    ent, lin, res = "entity_id string, entity_type string, created_at int", "workspace_id string, source_lineage_key string, knowledge_object_id string", "run_id string, status string"
    tables = {"objects": t([("k1", "active", 1), ("k2", "active", 1), ("k3", "active", 1)], obj), "object_sources": t([("k1", "P", "r0", "c", True), ("k2", "P", "r0", "c", True), ("k3", "Q", "r0", "c", True), ("k2", "Q", None, "c", True)], src), "relationships": t([("e1", "active"), ("e2", "active")], rel), "relationship_sources": t([("e1", "P", "r0", True), ("e2", "Q", "r0", True)], rsrc), "entities": t([("b1", "ORG", 1)], ent), "lineages": t([], lin), "build_results": t([], res)}
    build = {"objects": t([("k4", "new", 9), ("k1", "new", 9)], obj), "object_sources": t([("k4", "P", "r1", "c", True), ("k1", "P", "r1", "c", True)], src), "relationships": t([], rel), "relationship_sources": t([], rsrc), "entities": t([("b1", "PERSON", 9), ("b2", "ORG", 9)], ent), "lineages": t([("w", "l", "k4")], lin), "build_results": t([("r1", "completed")], res)}
    out = dml.commit_formation(tables, build, "P", "completed")
    assert {r["knowledge_object_id"]: (r["status"], r["created_at"]) for r in out["objects"].collect()} == {"k1": ("active", 1), "k2": ("active", 1), "k3": ("active", 1), "k4": ("active", 9)}
    assert {r["relationship_id"]: r["status"] for r in out["relationships"].collect()} == {"e1": "inactive", "e2": "active"}
    assert {r["entity_id"]: (r["entity_type"], r["created_at"]) for r in out["entities"].collect()} == {"b1": ("ORG", 1), "b2": ("ORG", 9)}
    tables["object_sources"] = tables["object_sources"].where("run_id is not null")
    assert dml.commit_formation(tables, build, "P", "completed")["objects"].where("status = 'superseded'").first()["knowledge_object_id"] == "k2"
    held = dml.commit_formation(tables, build, "P", "review_required")
    assert held["objects"].count() == 3 and held["build_results"].count() == 1
    store = dml.Store(spark, str(tmp_path / "s"))
    store.write({"entities": tables["entities"], "lineages": tables["lineages"]})
    store.write({"entities": out["entities"]})
    assert store.read("entities").count() == 2 and store.read("lineages").count() == 0
    gone = dml.append_with_ttl(spark.sql("select 'a' id, timestamp'2020-01-01' expires_at"), spark.sql("select 'b' id"), 5)
    assert [r["id"] for r in gone.collect()] == ["b"]


def test_fuzzy_matches_of_all_keys(spark, tmp_path):
    """Keys of equal parity match, and a second match of a part's own parity makes it ambiguous."""
    from claimforge.queries import q_fuzzy_match

    base = "abcdefghijklmnopqrst"
    names = {2: "red oak table large", 4: "red oak table larger", 10: "12" + base[2:], 11: base, 13: base[:-2] + "34", 20: "green elm desk", 21: "green elm desks"}
    spark.createDataFrame([("t", 1, k, n) for k, n in names.items()] + [("t", 2, 30, base)], "p_type string, p_size int, p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted((r["a_id"], r["b_id"]) for r in q_fuzzy_match(spark, str(tmp_path)).collect()) == [(2, 4), (20, 21)]


def work(module, kind, content, sources):
    row = {"module": module, "object_type": kind, "realization": json.dumps({"content": content, "claimUsage": []}, ensure_ascii=False)}
    return C.Work(row | {"claims": [{"claim_id": f"c{i}", "claim_kind": "fact", "statement": "s", "subject": "s", "attributes": "{}", "evidence": [{"anchor_id": "A", "exact_quote": "q", "selector": None, "source_text": t}]} for i, t in enumerate(sources)]})


def test_numbered_highlights_replace_checks():
    """A number alone on its line heads a highlight; a broken first line is joined; the last source of a number stands."""
    first = "".join(f"亮点{n}\n价值{n}\n说明很长的一行\n" for n in range(1, 7))
    w = work("D1.1", "SELLING_POINT", {"observableChecks": ["x"]}, [first, "亮点 2 \n\n  第二个价\n值\n其他"])
    w.replace_highlights()
    assert w.content["observableChecks"] == ["亮点1：价值1", "亮点2：第二个价值", "亮点3：价值3", "亮点4：价值4", "亮点5：价值5", "亮点6：价值6"]
    assert [u["claimId"] for u in w.usage] == ["c0", "c1", "c0", "c0", "c0", "c0"]
    inline = work("D1.1", "SELLING_POINT", {"observableChecks": ["x"]}, ["".join(f"亮点{n}：价值{n}\n" for n in range(1, 7))])
    inline.replace_highlights()
    assert inline.content["observableChecks"] == ["x"]


def test_backfill_looks_at_module_and_list():
    fact = "意外无等待期；疾病7天等待期"
    for module, rules, want in (("D1.2", ["等待期说明"], ["等待期说明", fact]), ("D1.2", [fact], [fact]), ("D1.1", ["等待期说明"], ["等待期说明"]), ("D1.2", [f"见：{fact}"], [f"见：{fact}", fact])):
        w = work(module, "POLICY_RULE_SET", {"rulesOrSteps": rules}, [f"产品 {fact}。"])
        w.backfill()
        assert w.content["rulesOrSteps"] == want


def test_upsert_keeps_one_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "c", "n"), (3, "d", "n"), (3, "e", "n")], "k int, v string, made string")
    assert sorted(tuple(r) for r in dml.upsert(old, new, ["k"]).collect()) == [(1, "a", "x"), (2, "c", "n"), (3, "e", "n")]
    assert sorted(tuple(r) for r in dml.upsert(old, new, ["k"], keep=("made",)).collect()) == [(1, "a", "x"), (2, "c", "y"), (3, "e", "n")]


def test_markdown_files_are_one_for_each_object(spark, tmp_path):
    (tmp_path / "knowledge" / "D1").mkdir(parents=True)
    (tmp_path / "knowledge" / "D1" / "other.md").write_text("stays")
    rows = [("knowledge/D1/a.md", "# a"), ("knowledge/D2/D2.1/b.md", "# b")]
    for _ in range(2):
        M.write_markdown(spark.createDataFrame(rows, "file_path string, markdown string"), str(tmp_path))
    files = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert files == dict(rows) | {"knowledge/D1/other.md": "stays"}


def test_builds_are_committed(spark, judged, tmp_path):
    """A first build, the same again, a third under review, and a store that fails: files, tables and reads."""
    from claimforge.plans.engine import Engine

    engine = Engine(spark, str(tmp_path))
    accepted = judged[0].where("size(quality_issues) = 0").withColumn("workspace_id", F.lit("w"))
    made = engine.form(accepted)
    done = engine.commit(made, "d", "r1", embedder=hashing_embedder(engine.settings.embedding_dimension))
    n = made["objects"].count()
    assert done["status"] == "completed" and {s for s, _ in done["sinks"].values()} == {"completed"}
    stored = engine.knowledge_objects("d").collect()
    assert len(stored) == n > 0 and {r["status"] for r in stored} == {"active"}
    for r in stored:
        text = (tmp_path / r["file_path"]).read_bytes()
        assert hashlib.sha256(text).hexdigest() == r["file_sha256"]
    assert engine.around("d").count() == n and engine.around("d", 2).where("depth = 2").select("label").distinct().collect() == [("BusinessEntity",)]
    assert engine.vectors("d").where(F.size("embedding") == engine.settings.embedding_dimension).count() >= n
    again = engine.form(accepted)
    assert {r["action"] for r in again["objects"].collect()} == {"reused"}

    def broken(texts):
        raise RuntimeError("no vectors")

    second = engine.commit(again, "d", "r2", embedder=broken)
    assert second["status"] == "completed" and second["sinks"]["vectors"][0] == "failed" and second["sinks"]["graph"][0] == "completed"
    assert engine.store.read("object_sources").where("active").select("run_id").distinct().collect() == [("r2",)]
    held = engine.commit(again, "d", "r3", blockers=spark.createDataFrame([("d", "gold is draft"), ("e", "other")], "doc_id string, blocker string"))
    assert held == {"status": "review_required", "blockers": ["gold is draft"]}
    assert {r["run_id"]: r["status"] for r in engine.store.read("build_results").collect()} == {"r1": "completed", "r2": "completed", "r3": "review_required"}
    assert engine.knowledge_objects("d").count() == n and engine.store.read("edges").where("type = 'CONTAINS'").count() == n
    fewer = engine.form(accepted.where("object_type <> 'QA_PAIR'"))
    assert engine.commit(fewer, "d", "r4")["status"] == "review_required"


def test_gold_files_ask_for_field_evidence(spark, judged, claims, tmp_path):
    """The file's requireFieldEvidence makes the same candidates answer for each field."""
    from claimforge.plans.engine import Engine

    none = spark.createDataFrame([], "doc_id string, claim_id string, reason string")
    result = {"candidates": judged[0], "claims": claims, "unresolved": none}
    reports = {}
    for name, strict in (("loose", False), ("strict", True)):
        folder = tmp_path / name / "d"
        folder.mkdir(parents=True)
        (folder / "gold-v1.json").write_text(json.dumps({"expectedObjectGroups": GROUPS[:1], "requireFieldEvidence": strict}))
        engine = Engine(spark, str(tmp_path))
        engine.packages = lambda: spark.createDataFrame([("d", "s", "m", ["a"])], "doc_id string, source_sha256 string, full_markdown_sha256 string, anchors array<string>")
        reports[name] = engine.score(result, str(tmp_path / name))["groups"].collect()
    assert [r["status"] for r in reports["loose"]] == ["met"] and len(reports["strict"]) == 1
