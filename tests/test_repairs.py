"""The engine's second passes with a scripted model: JSON repair, coverage repair with additions, one more realization."""

import json

import pytest

from claimforge.plans.engine import Engine
from claimforge.sources import gateways
from claimforge.sources.settings import Settings
from tests.standins import hashing_embedder
from tests.test_engine import TEXT, package

CLAIMS = [{"claimId": f"c{i}", "claimKind": "qa", "statement": q, "subject": q, "attributes": {"question": q, "answer": a}, "moduleHints": ["D4.2"], "evidence": [{"anchorId": "P#1", "exactQuote": q}]} for i, (q, a) in enumerate([("怎么退", "联系客服"), ("多久到", "三天")], 1)]
PLAN = ["p1", "问答", "D4.2", "QA_PAIR", {"subject": "常见问题", "applicability": "全部"}]
WHOLE = {"items": [{"question": "怎么退", "answer": "联系客服", "claimRef": "c1"}, {"question": "多久到", "answer": "三天", "claimRef": "c2"}], "factReferences": ["c1"], "applicability": "全部"}
USAGE = [{"claimId": f"c{i}", "role": "primary", "contentPaths": [f"$.items[{i - 1}]", "$.applicability"]} for i in (1, 2)]


def model(content=WHOLE, additions=(), first=("c1",), spoil=None, cut=None, aside=None, second="qa", relations=()):
    """A gateway: `content` of the first realization, `additions` of the coverage repair, a purpose whose answers are spoilt or cut, and
    the kind of the second claim (the plan for questions takes all questions of its anchor, but no fact)."""

    def gateway(purpose, prompt):
        if purpose == "discover":
            body = {"claims": [CLAIMS[0], {**CLAIMS[1], "claimKind": second}]}
        elif purpose == "plan":
            body = {"objectPlans": [[*PLAN, list(first)]], **(aside or {})}
        elif purpose == "coverage_repair":
            body = {"objectPlans": [], "planAugmentations": list(additions)}
        elif purpose == "json_repair":
            return {"content": prompt.split("\n\n", 1)[1].removeprefix("Sure: ")}
        else:
            body = {"realizations": [{"planId": "p1", "content": WHOLE if purpose == "content_repair" else content, "claimUsage": USAGE, "relations": list(relations)}]}
        text = json.dumps(body, ensure_ascii=False)
        return {"content": "Sure: " + text if purpose == spoil else text, "truncated": purpose == cut}

    return gateway


@pytest.fixture
def engine(spark, tmp_path):
    package(tmp_path, "DP-1", TEXT)
    return Engine(spark, str(tmp_path))


def calls_of(got):
    return sorted((r["purpose"], r["ok"]) for r in got["calls"].collect())


def test_invalid_json_gets_one_repair_call(spark):
    asked = spark.createDataFrame([("a", "plan", "p"), ("b", "plan", "q")], "request_id string, purpose string, prompt string")

    def gateway(purpose, prompt):
        if purpose == "json_repair":
            return {"content": '{"x": 1}' if "soup" in prompt else "still soap"}
        return {"content": "soup" if prompt == "p" else "soap"}

    rows = gateways.complete(asked, gateway, retries=3, partitions=1, repair_prompt=lambda text: f"mend: {text}").collect()
    assert [(r["request_id"], r["purpose"], r["attempt"], r["ok"]) for r in rows] == [("a", "plan", 1, False), ("a", "json_repair", 2, True), ("b", "plan", 1, False), ("b", "json_repair", 2, False)]


def test_truncated_output_fails_closed_without_repair(spark):
    asked = spark.createDataFrame([("a", "plan", "p")], "request_id string, purpose string, prompt string")
    rows = gateways.complete(asked, lambda purpose, prompt: {"content": '{"x": ', "truncated": True}, retries=3, partitions=1, repair_prompt=str).collect()
    assert [(r["purpose"], r["ok"], r["error"]) for r in rows] == [("plan", False, "output limit reached")]


def test_spoilt_plans_are_mended_in_the_engine(engine):
    got = engine.identify(model(first=("c1", "c2"), spoil="plan"))
    assert [r["candidate_id"] for r in got["candidates"].collect()] == ["p1"]
    assert ("json_repair", True) in calls_of(got) and ("plan", False) in calls_of(got)


def test_coverage_repair_appends_to_plans(engine):
    """A claim that no plan covers joins one by an addition; an addition that names an unknown claim is refused whole."""
    got = engine.identify(model(second="fact", additions=[{"planId": "p1", "sourceClaimIds": ["c2", "nowhere"]}, {"planId": "p9", "sourceClaimIds": ["c2"]}, {"planId": "p1", "sourceClaimIds": []}, {"planId": "p1", "sourceClaimIds": ["c2"]}]))
    (plan,) = got["plans"].collect()
    assert plan["plan_id"] == "p1" and plan["claim_ids"] == ["c1", "STRUCTURED-NUMBERED-QA-1", "c2"]  # the second question's own claim is made from the text
    assert sorted((r["plan_id"], r["reasons"]) for r in got["rejected_plans"].collect()) == [("p1", ["no claims"]), ("p1", ["unknown claims: nowhere"]), ("p9", ["unknown plan"])]
    assert ("coverage_repair", True) in calls_of(got)


def test_what_the_planner_explains_is_not_asked_again(engine):
    aside = {"unresolvedItems": [{"claimId": "c2", "description": "d", "reason": "another document says more", "evidence": ["P#1"], "module": "D4.2"}, {"description": "", "reason": "r", "evidence": ["X"]}], "weakSignals": [{"module": "D2.1", "reason": "r", "evidence": ["P#1"]}, {"module": "D0", "reason": "r", "evidence": ["P#1"]}]}
    got = engine.identify(model(content={**WHOLE, "items": WHOLE["items"][:1]}, aside=aside, second="fact"))
    assert ("coverage_repair", True) not in calls_of(got)
    assert {(r["claim_id"], r["reason"]) for r in got["unresolved"].collect()} == {("c2", "another document says more")}
    assert got["weak_signals"].count() == 1 and got["open_items"].count() == 1 and got["rejected_items"].count() == 2
    assert {r["module"]: r["status"] for r in got["coverage"].collect() if r["status"] != "not_found"} == {"D4.2": "hit", "D2.1": "weak_signal"}


def test_content_is_realized_once_more(engine):
    got = engine.identify(model(content={"items": WHOLE["items"], "factReferences": ["c1"]}, first=("c1", "c2")))
    assert [r["candidate_id"] for r in got["candidates"].collect()] == ["p1"] and got["rejected_candidates"].count() == 0
    assert calls_of(got) == [("content_repair", True), ("discover", True), ("plan", True), ("realize", True)]
    assert got["unresolved"].count() == 0


def test_no_second_realization_beyond_the_calls_or_for_other_reasons(spark, engine):
    lacking = {"items": WHOLE["items"], "factReferences": ["c1"]}
    few = Engine(spark, engine.root, settings=Settings(repair_calls=3))
    got = few.identify(model(content=lacking, first=("c1", "c2")))
    assert got["candidates"].count() == 0 and [r["candidate_id"] for r in got["rejected_candidates"].collect()] == ["p1"]
    assert "content_repair" not in {p for p, _ in calls_of(got)}
    foreign = [{"relationKind": "k", "relationType": "t", "sourceRef": "p1", "targetRef": "p1", "evidence": ["X"]}]
    held = engine.identify(model(content=lacking, first=("c1", "c2"), relations=foreign))
    assert "content_repair" not in {p for p, _ in calls_of(held)}


def test_a_cut_second_answer_keeps_the_first_result(engine):
    got = engine.identify(model(content={"items": WHOLE["items"], "factReferences": ["c1"]}, first=("c1", "c2"), cut="content_repair"))
    assert ("content_repair", False) in calls_of(got)
    assert got["candidates"].count() == 0 and [r["candidate_id"] for r in got["rejected_candidates"].collect()] == ["p1"]


def gold_of(folder, **more):
    folder.mkdir(parents=True, exist_ok=True)
    group = {"key": "qa", "expectedCount": 1, "module": "D4.2", "objectTypes": ["QA_PAIR"], "evidence": ["P#1"]}
    (folder / "gold-v1.json").write_text(json.dumps({"status": "approved", "catalogVersion": "d1-d5-v0.9", "expectedObjectGroups": [group]} | more))


def test_release_is_gated_by_the_gold_file(engine, tmp_path):
    """A reviewed result is stored; a draft, another version, an open claim or no gold file at all hold it for review."""
    got = engine.identify(model(first=("c1", "c2")))
    embedder, gold = hashing_embedder(engine.settings.embedding_dimension), tmp_path / "gold"
    held = {}
    for name, more in (("draft", {"status": "proxy_draft"}), ("other", {"contentContractVersion": "another"})):
        gold_of(gold / name / "DP-1", **more)
        done = engine.release(got, "DP-1", name, str(gold / name), embedder=embedder)
        assert done["status"] == "review_required"
        held[name] = done["blockers"]
    assert "gold is proxy_draft" in held["draft"] and "gold is bound to other versions" in held["other"]
    gold_of(gold / "none" / "DP-9")
    assert engine.release(got, "DP-1", "none", str(gold / "none"), embedder=embedder)["blockers"] == ["no gold file was reviewed"]
    aside = {"unresolvedItems": [{"claimId": "c2", "description": "d", "reason": "r", "evidence": ["P#1"], "module": "D4.2"}]}
    left = engine.identify(model(content={**WHOLE, "items": WHOLE["items"][:1]}, aside=aside, second="fact"))
    gold_of(gold / "good" / "DP-1")
    assert "1 claims are open" in engine.release(left, "DP-1", "open", str(gold / "good"), embedder=embedder)["blockers"]
    done = engine.release(got, "DP-1", "r1", str(gold / "good"), embedder=embedder)
    assert done["status"] == "completed" and done["blockers"] == []
    assert {r["document_package_id"] for r in engine.store.read("object_sources", "DP-1").collect()} == {"DP-1"}
