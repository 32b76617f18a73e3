"""Work that must be done once whatever the size: seen in plans."""

import pytest

from claimforge import stage_queries
from claimforge.operators import contracts as CC
from claimforge.queries import QUERIES
from claimforge.rules import RuleSet

SF = "/root/testdata/sf0.001"


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contents_are_parsed_once(spark):
    """A parse written into each rule that reads the fields, or rules run once more to see whether there is anything to list."""
    assert optimised(QUERIES["q_contract_violations"](spark, SF)).lower().count("parsejson") == 1


def test_odd_contents(spark):
    """Absent and null fields, lists of nulls, zeros, and what is no object."""
    kind, module = "QA_PAIR", "D4.2"
    rows = [(1, '{"items":[null],"factReferences":[],"applicability":0}'), (2, '{"items":null,"factReferences":{},"applicability":""}'), (3, "[1]"), (4, "no json"), (5, None), (6, '{"items":[],"factReferences":["c"],"applicability":"a"}')]
    made = spark.createDataFrame([(i, kind, module, c) for i, c in rows], "i int, object_type string, module string, content string")
    got = {r["i"]: [(v["place"], v["kind"], v["fields"]) for v in r["violations"]] for r in CC.with_violations(made, RuleSet.built_in()).collect()}
    everything = [("$", "missing", ["items", "factReferences", "applicability"])]
    assert got[3] == got[4] == got[5] == everything
    assert got[1] == [("$", "missing", ["factReferences"]), ("$", "type", ["applicability must be text"]), ("item 1", "item_object", [])]
    assert [v for v in got[2] if v[1] == "missing"] == everything
    assert got[6] == [("$", "missing", ["items"])]


@pytest.mark.parametrize("name", ["q_plan_rules", "q_uncovered_claims", "q_granularity_metrics"])
def test_lines_are_numbered_once(spark, name):
    """Plans and claims are made of one numbering of the lines, which lies settled; it was sorted anew for each of them."""
    assert "row_number" not in optimised(getattr(stage_queries, name)(spark, SF))


def test_rows_of_one_claim_id_are_covered_together(spark):
    from claimforge.operators import planning as P

    evidence = "array<struct<anchor_id string, exact_quote string, selector string, source_text string>>"
    claims = spark.createDataFrame([(1, 1, "a", "rule", "s", "t", "{}", []), (1, 2, "a", "list", "s", "t", "{}", []), (1, 3, "b", "list", "s", "t", "{}", []), (2, 1, "a", "rule", "s", "t", None, [])], f"doc_id int, pos int, claim_id string, claim_kind string, statement string, subject string, attributes string, evidence {evidence}")
    plans = spark.createDataFrame([(1, 1, "D1.2", "BUSINESS_PROCESS", ["a", "b", "a"]), (2, 1, None, None, ["a"])], "doc_id int, pos int, module string, object_type string, claim_ids array<string>")
    left = P.uncovered(plans, claims, RuleSet.built_in())
    assert left.columns == claims.columns and sorted((r["doc_id"], r["pos"]) for r in left.collect()) == [(1, 3), (2, 1)]


def test_hints_are_parsed_once(spark):
    """Each field parsed the hints again, along a path made anew for each row, after a join with the contracts."""
    from claimforge.operators import planning as P

    rows = [(1, "PRODUCT_FACT", '{"subject":"a","versionScope":{"b":1,"a":[]},"factTheme":""}'), (2, "PRODUCT_FACT", "no json"), (3, "PRODUCT_FACT", None), (4, "none such", "{}"), (5, None, "{}"), (6, "PRODUCT_FACT", '{"subject":null,"versionScope":0}')]
    told = P.identity_missing(RuleSet.built_in(), spark.createDataFrame(rows, "i int, object_type string, identity_hints string"))
    three = ["subject", "versionScope", "factTheme"]
    assert {r["i"]: (r["missing_identity"], r["identity_json"]) for r in told.collect()} == {1: (["factTheme"], '"a",{"a":[],"b":1},""'), 2: (three, "null,null,null"), 3: (three, "null,null,null"), 4: ([], ""), 5: ([], ""), 6: (["subject", "factTheme"], "null,0,null")}
    plan = optimised(told.where("object_type = 'PRODUCT_FACT'")).lower()
    assert "join left" not in plan and "concat($." not in plan


def test_candidates_stay_where_they_are(spark, monkeypatch):
    """Without current objects nothing is matched: no candidate is joined to place it, and members are collected once."""
    from claimforge.operators import formation as M
    from claimforge.plans.engine import STORED

    plans = []
    monkeypatch.setattr(M, "settle", lambda df, real=M.settle: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    none = lambda schema: spark.createDataFrame([], schema)
    lines = M.settle(none(stage_queries.NO_LINES))
    made = M.form(stage_queries.parts_as_candidates(spark, SF), none(STORED), lines, none(stage_queries.NO_ACTIVE), RuleSet.built_in())
    grouped = [p for p in plans if "collect_list" in p]
    assert len(grouped) == 1 and grouped[0].count("collect_list(") == 2 and "distinct content" not in grouped[0]  # members, entity references
    assert made["objects"].count() > 0
