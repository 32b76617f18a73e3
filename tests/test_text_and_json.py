"""Functions, segmentation and claims on literal cases."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from claimforge.functions import json_ops, numbers, text
from claimforge.operators import claims as K, segments as S


def values(spark, rows, schema, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_normal_forms(spark):
    got = values(spark, [("  Straße　 X ",), ("“你好”，（A）b!",), (None,)], "x string", e=text.entity_name(F.col("x")), v=text.evidence_text(F.col("x")), s=text.same_text_key(F.col("x")))
    assert got[0] == ("strasse x", "strassex", "strassex") and got[1][1] == "你好ab" and got[2] == (None, None, None)


def test_questions_and_support(spark):
    got = values(spark, [("这个多少钱",), ("怎么办理",), ("可以吗 ",), ("好的",)], "x string", q=text.question_like(F.col("x")))
    assert [g[0] for g in got] == [True, True, True, False]
    got = values(spark, [("等待期7天；无免赔", "本产品等待期 7 天。无免赔额"), ("等待期8天", "等待期7天"), ("；", "x")], "v string, s string", ok=text.supported_by(F.col("v"), F.col("s")))
    assert [g[0] for g in got] == [True, False, False]


def test_natural_order_and_prefix(spark):
    got = spark.createDataFrame([("p10",), ("p2",), ("p1a",)], "x string").orderBy(text.natural_key(F.col("x"))).collect()
    assert [r[0] for r in got] == ["p1a", "p2", "p10"]
    assert values(spark, [(["abcd", "abx", "abc"],)], "x array<string>", p=text.common_prefix(F.col("x"))) == [("ab",)]


def test_json(spark):
    doc = json.dumps({"b": [1, {"x": "y", "claimRef": "c"}, ""], "a": None, "c": False, "category": "k"})
    got = values(spark, [(doc,)], "d string", l=json_ops.leaves(F.col("d")), k=json_ops.drop_keys(F.col("d"), "claimRef"), c=json_ops.canonical_json(F.lit('{"b":1, "a":"é"}')))
    assert [(x["path"], x["value"]) for x in got[0][0]] == [("$.b[0]", "1"), ("$.b[1].x", "y"), ("$.c", "false")]
    assert "claimRef" not in got[0][1] and got[0][2] == '{"a":"é","b":1}'
    got = values(spark, [('{"a":[1,2],"b":{"c":1}}', '{"a":[1,3,4],"d":0,"b":{"c":true}}')], "o string, n string", p=json_ops.changed_paths("o", "n"))
    assert sorted(got[0][0]) == ["$.a[1]", "$.a[2]", "$.b.c", "$.d"]
    empties = [("null",), ('""',), ("[]",), ("{ }",), ("0",), ("false",), (None,)]
    assert [g[0] for g in values(spark, empties, "x string", e=json_ops.is_empty_json(F.col("x")))] == [True, True, True, True, False, False, True]
    got = values(spark, [('{"a":{"b":[{"c":1}],"stepId":2}}', ["$.a", "$.content.a", "$.a.stepId", "$.z"])], "d string, p array<string>", l=json_ops.leaves_under(F.col("d"), F.col("p")))
    assert [(x["given"], x["path"]) for x in got[0][0]] == [("$.a", "$.a.b[0].c"), ("$.content.a", "$.a.b[0].c")]


def test_numbers(spark):
    got = values(spark, [(1, 3), (1, 0)], "a int, b int", r=numbers.rate(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [0.3333, 0.0]
    pairs = [("药享保", "药享保险"), ("", ""), ("abc", "xyz")]
    assert [g[0] for g in values(spark, pairs, "a string, b string", r=numbers.gestalt_ratio("a", "b"))] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


PAGE = "# 标题\n\n## 第 1 页\n<!-- source-anchor: D#page-1 -->\n甲\n\n## 第 2 页\n<!-- source-anchor: D#page-2 -->\n" + "乙" * 40 + "\n\n## 第 3 页\n<!-- source-anchor: D#page-3 -->\n丙"


def test_segments(spark):
    df = spark.createDataFrame([("d", PAGE), ("plain", "x" * 500)], "doc_id string, full_markdown string")
    whole = S.segment(df, 10_000).collect()
    assert {(r["doc_id"], r["total"]) for r in whole} == {("d", 1), ("plain", 1)}
    cut = S.segment(df.where("doc_id = 'd'"), 80).orderBy("index").collect()
    assert [r["label"] for r in cut] == [f"S{i}/{len(cut)}" for i in range(1, len(cut) + 1)] and len(cut) == -(-len(PAGE) // 80)
    assert cut[0]["markdown"].startswith("# 标题") and sum((r["cited_anchors"] for r in cut), []) == ["D#page-1", "D#page-2", "D#page-3"]
    anchors = spark.createDataFrame([("d", f"D#page-{i}") for i in (1, 2, 3, 4)], "doc_id string, anchor_id string")
    assert S.segment_anchors(S.segment(df, 80), anchors, "doc_id").count() == 3


def test_packing_of_sections(spark):
    def plain(sections, total, limit):
        import math

        n = math.ceil(total / limit)
        target, done, cur = math.ceil(total / n), [], ""
        for s in sections:
            new = f"{cur}\n\n{s}".strip() if cur else s
            if cur and len(new) > target and len(done) < n - 1:
                done, cur = [*done, cur], s
            else:
                cur = new
        return done + ([cur] if cur else [])

    cases = [(["a" * n for n in ns], sum(ns), limit) for ns in ([5, 5, 5, 5], [30, 1, 1], [1] * 9, [7, 20, 3, 9, 9]) for limit in (4, 10, 25)]
    got = values(spark, cases, "s array<string>, n int, k int", p=S.packed(F.col("s"), F.col("n"), 10))
    assert [g[0] for g in got] == [plain(s, n, 10) for s, n, _ in cases]


def test_sections_and_cells(spark):
    text_ = "<!-- source-anchor: A -->\none\n<!-- source-anchor: B -->\n- **A列**：异议处理\n- **B列**：太贵了\n- **D列**：您好\n再见\n<!-- source-anchor: A -->\nlast"
    df = spark.createDataFrame([("d", text_)], "doc_id string, m string")
    got = {r["anchor_id"]: r["section"] for r in S.anchor_sections(df, "doc_id", "m").collect()}
    assert got["A"].endswith("last") and set(got) == {"A", "B"}
    row = values(spark, [(got["B"],)], "s string", b=S.cell(F.col("s"), "B列"), d=S.cell(F.col("s"), "D列"), c=S.cell(F.col("s"), "C列"))
    assert row == [("太贵了", "您好\n再见", None)]
    lone = spark.createDataFrame([("d", "no anchors", [("X",)]), ("e", "none", [("X",), ("Y",)])], "doc_id string, m string, a array<struct<anchor_id string>>")
    assert [(r["anchor_id"], r["section"]) for r in S.document_sections(lone, "doc_id", "m", "a").collect()] == [("X", "no anchors")]


@pytest.mark.parametrize("source,quote,want", [("**保障** `期`间", "保障期间", "保障** `期`间"), ("abc", "abc", "abc"), ("甲方 应当 在 三十日 内 付款", "甲方 三十日", "甲方 应当 在 三十日"), ("x", "yy zz", None), ("x", "", ""), ("ab-cd", "abcd", "ab-cd")])
def test_quotes(source, quote, want):
    assert K.find_span(source, quote) == want


def claim(i, kind, anchor, quote, **more):
    return json.dumps({"claimId": i, "claimKind": kind, "statement": more.pop("statement", quote), "subject": more.pop("subject", "s"), "attributes": more.pop("attributes", {}), "moduleHints": ["D1.1", "D9.9"], "evidence": [{"anchorId": anchor, "exactQuote": quote} | more]}, ensure_ascii=False)


def test_claims_are_checked_against_their_source(spark):
    sections = spark.createDataFrame([("d", "A", 0, "<!-- source-anchor: A -->\n登录 -> 选择\n提交"), ("d", "T", 1, "- **B列**：问\n- **C列**：答")], "doc_id string, anchor_id string, pos int, section string")
    raw = [claim("c1", "process", "A", "登录->选择", statement="登录 -> 选择 -> 提交"), claim("c1", "fact", "A", "提交"), claim("c2", "fact", "Z", "x"), claim("c3", "fact", "A", "absent words"), claim("c4", "qa", "T", "other", selector="C列"), claim("c5", "qa", "T", "x", selector="H列"), "[1]", claim("c6", "nokind", "A", "提交"), json.dumps(["c7", "fact", "提交了", "主题", [["A", "登录…提交"]]], ensure_ascii=False)]
    df = spark.createDataFrame([("d", i, r) for i, r in enumerate(raw, 1)], "doc_id string, pos int, raw string")
    good, bad = K.validate(df, sections, ["D1.1"])
    got = {r["claim_id"]: r for r in good.collect()}
    assert set(got) == {"c1", "c4", "c7"}
    assert json.loads(got["c1"]["attributes"])["steps"] == ["登录", "选择", "提交"] and got["c1"]["module_hints"] == ["D1.1"]
    assert got["c4"]["evidence"][0]["exact_quote"] == "答" and [e["exact_quote"] for e in got["c7"]["evidence"]] == ["登录", "提交"]
    why = {r["pos"]: r["reasons"] for r in bad.collect()}
    assert why[2] == ["duplicate claim id: c1"] and why[3][0].startswith("unknown evidence anchor") and why[4][0].startswith("exact quote not found") and why[6][0].startswith("unknown evidence selector")
    assert why[7] == ["claim must be a JSON object"] and why[8] == ["unknown claim kind: nokind"]


def test_source_structure_adds_claims(spark):
    rows = [
        ("d", "H", 0, "- **A列**：异议处理\n- **B列**：问题\n- **C列**：解答"), ("d", "R1", 1, "- **A列**：异议处理\n- **B列**：太贵了，可以分期吗\n- **D列**：可以分期"), ("d", "R2", 2, "- **B列**：不需要\n- **D列**：理解您"),
        ("d", "R3", 3, "- **A列**：FAQ\n- **B列**：在哪买\n- **C列**：官网"), ("d", "Q", 4, "Q1：怎么退\nA1：联系\n客服\nQ2：多久到\nA2：三天"), ("d", "N", 5, "YXB的电话是400-1234。"),
    ]
    sections = spark.createDataFrame(rows, "doc_id string, anchor_id string, pos int, section string")
    kinds = [(r["anchor_id"], r["claim_kind"]) for r in K.table_duties(sections).orderBy("pos", "duty").collect()]
    assert kinds == [("R1", "objection"), ("R1", "qa"), ("R2", "objection"), ("R3", "qa")]
    have = spark.createDataFrame([("d", 1, "c1", "objection", "贵", "贵", '{"rootCause":"guess","k":"v"}', ["D4.1"], [("R1", "贵", None, "贵")])], "doc_id string, pos int, claim_id string, claim_kind string, statement string, subject string, attributes string, module_hints array<string>, evidence array<struct<anchor_id string, exact_quote string, selector string, source_text string>>")
    got = {r["claim_id"]: r for r in K.supplement(have, sections).collect()}
    first = json.loads(got["c1"]["attributes"])
    assert first == {"k": "v", "expression": "太贵了，可以分期吗", "responseContext": "可以分期"}
    by = sorted((r["claim_kind"], r["evidence"][0]["anchor_id"]) for r in got.values())
    assert by == [("objection", "R1"), ("objection", "R2"), ("qa", "Q"), ("qa", "Q"), ("qa", "R1"), ("qa", "R3"), ("term", "N")]
    answers = {json.loads(r["attributes"]).get("question"): json.loads(r["attributes"]).get("answer") for r in got.values() if r["claim_kind"] == "qa"}
    assert answers["怎么退"] == "联系客服" and answers["多久到"] == "三天"
    anchors = spark.createDataFrame([("d", a) for a in ("R1", "Q", "none")], "doc_id string, anchor_id string")
    empty = spark.createDataFrame([], "doc_id string, raw string")
    assert [r["anchor_id"] for r in K.unclaimed_anchors(anchors, have, empty).orderBy("anchor_id").collect()] == ["Q", "none"]


def test_macros():
    claims = {"c": {"kind": "fact", "subject": "s", "attributes": {"k": "v"}, "evidence": [{"exact_quote": "q", "source_text": "whole"}]}, "o": {"kind": "objection", "subject": "s", "attributes": {"expression": "太贵"}, "evidence": []}}
    issues = []
    out = K.resolve_macros({"a": {"$verbatimFromClaim": "c"}, "b": [{"$exactQuoteFromClaim": "c"}], "d": {"$attributeFromClaim": {"claimId": "c", "attribute": "k"}}, "e": {"$verbatimFromClaim": "o"}, "f": '{"$verbatimFromClaim": "c"}', "g": {"$verbatimFromClaim": "zz"}}, claims, issues)
    assert out == {"a": "whole", "b": ["q"], "d": "v", "e": "太贵", "f": "whole", "g": ""} and len(issues) == 1


def test_casefold_is_unicodes(spark):
    words = ["Straße", "ΟΔΟΣ", "ὈΔΥΣΣΕΎΣ ς", "ﬁn ﬂat ﬃ", "ſ µ K Å", "İstanbul", "ᏣᎳᎩ ꮳ", "ẞ ŉ ǰ", "𐐀 😀 漢字", "plain ASCII", ""]
    assert [f for (f,) in values(spark, [(w,) for w in words], "w string", f=text.casefold(F.col("w")))] == [w.casefold() for w in words]


def test_claims_of_segments(spark):
    """Equal numbers in two segments are two claims; evidence of another segment is refused; a blank selector is none."""
    claim = lambda number, anchor, quote, selector=None: json.dumps({"claimId": number, "claimKind": "fact", "statement": "s", "subject": "t", "attributes": {}, "moduleHints": [], "evidence": [{"anchorId": anchor, "exactQuote": quote, "selector": selector}]})
    rows = [("d", 1, 1, 2, claim("c1", "A", "one", "  ")), ("d", 2, 2, 2, claim("c1", "B", "two")), ("d", 3, 2, 2, claim("c2", "A", "one")), ("d", 4, 2, 2, claim("c1", "B", "two"))]
    raw = spark.createDataFrame(rows, "doc_id string, pos int, part int, segments int, raw string")
    sections = spark.createDataFrame([("d", 1, "A", 0, "one text"), ("d", 2, "B", 0, "two texts")], "doc_id string, part int, anchor_id string, pos int, section string")
    good, bad = K.validate(raw, sections, [])
    assert sorted(r["claim_id"] for r in good.collect()) == ["S1-c1", "S2-c1"]
    assert {r["pos"]: list(r["reasons"]) for r in bad.collect()} == {3: ["unknown evidence anchor: A"], 4: ["duplicate claim id: S2-c1"]}


def test_packed_sections(spark):
    got = values(spark, [(["aa", "", "bb", "cc", "dddd"],), ([],), (["x"],)], "s array<string>", p=S.packed(F.col("s"), F.lit(14), 7))
    assert [list(p) for (p,) in got] == [["aa\n\nbb", "cc\n\ndddd"], [], ["x"]]


def test_sections_take_the_heading_before_them(spark):
    doc = "## 一\nbody\n## 章\n### 甲\n<!-- source-anchor: A -->\none\n## 节\n### 乙\n<!-- source-anchor: B -->\ntwo"
    got = values(spark, [(doc,)], "d string", s=S.sections(F.col("d")))
    assert [list(s) for (s,) in got] == [["## 一\nbody\n## 章\n### 甲\n<!-- source-anchor: A -->\none", "## 节\n### 乙\n<!-- source-anchor: B -->\ntwo"]]


def test_numbered_pairs(spark):
    from claimforge.operators.claims import numbered_pairs

    cases = {
        "Q1：a\nA1：b": [("1", "a", "b", "Q1：a\nA1：b")],
        "intro\nQ1: a\n more \nA1: b\n\nc\nQ2：d\nA2：e\n": [("1", "amore", "bc", "Q1: a\n more \nA1: b\n\nc\n"), ("2", "d", "e", "Q2：d\nA2：e\n")],
        "Q1：unanswered\nQ2：d\nA2：e": [("2", "d", "e", "Q2：d\nA2：e")],
        "Q1：a\nQ2：b\nA2：x\nA1：y": [("1", "aQ2：bA2：x", "y", "Q1：a\nQ2：b\nA2：x\nA1：y")],
        "Q1：a\nA1：b\nA7：c": [("1", "a", "bA7：c", "Q1：a\nA1：b\nA7：c")],
        "Q1：\nA1：b": [], "Q1：a\nA1：": [], " Q1：a\nA1：b": [], "Q1 a\nA1 b": [], "": [],
        "Q3：a\nA3：b\nQ3：c\nA3：d": [("3", "a", "b", "Q3：a\nA3：b\n"), ("3", "c", "d", "Q3：c\nA3：d")],
    }
    rows = [(i, "p", 0, text) for i, text in enumerate(cases)] + [(99, "p", 0, None)]
    got = numbered_pairs(spark.createDataFrame(rows, "doc_id int, anchor_id string, pos int, section string")).orderBy("doc_id", "nth").collect()
    for i, want in enumerate(cases.values()):
        assert [(r["number"], r["question"], r["answer"], r["pair"]) for r in got if r["doc_id"] == i] == want
    assert all(r["doc_id"] != 99 for r in got)
