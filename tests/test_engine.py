"""One document from files to projection with a scripted model, and the stream of packages."""

import hashlib
import json

from pyspark.sql import functions as F

from claimforge.plans.engine import Engine
from claimforge.sources import gateways
from claimforge.sources.packages import read_manifests
from claimforge.sources.settings import Settings
from tests.standins import hashing_embedder

TEXT = "## 第 1 页\n<!-- source-anchor: P#1 -->\nQ1：怎么退\nA1：联系客服\nQ2：多久到\nA2：三天\n"


def package(root, name, text=TEXT, digest=None):
    folder = root / "documents" / name
    folder.mkdir(parents=True)
    (folder / "full.md").write_text(text, encoding="utf-8")
    (folder / "source.bin").write_bytes(b"source")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    (folder / "manifest.json").write_text(json.dumps({"documentPackageId": name, "workspaceId": "w", "sourceFileName": "s", "sourceFilePath": f"documents/{name}/source.bin", "sourceSha256": sha(b"source"), "fullMarkdownPath": f"documents/{name}/full.md", "fullMarkdownSha256": digest or sha(text.encode()), "processingMethod": "capability", "status": "available", "anchors": [{"anchorId": "P#1", "kind": "page", "page": 1}], "qualityIssues": []}))


def model(purpose, prompt):
    if purpose == "discover":
        body = {"claims": [{"claimId": "c1", "claimKind": "qa", "statement": "怎么退", "subject": "怎么退", "attributes": {"question": "怎么退", "answer": "联系客服"}, "moduleHints": ["D4.2"], "evidence": [{"anchorId": "P#1", "exactQuote": "怎么退"}]}]}
    elif purpose in ("plan", "coverage_repair"):
        body = {"objectPlans": [["p1", "问答", "D4.2", "QA_PAIR", {"subject": "常见问题", "applicability": "全部"}, ["c1"]]]}
    else:
        body = {"realizations": [{"planId": "p1", "content": {"items": [{"question": "怎么退", "answer": "联系客服", "claimRef": "c1"}], "factReferences": ["c1"], "applicability": "全部"}, "claimUsage": [{"claimId": "c1", "role": "primary", "contentPaths": ["$.items[0]"]}]}]}
    return {"content": json.dumps(body, ensure_ascii=False), "promptTokens": len(prompt), "completionTokens": 1}


def test_documents_become_candidates(spark, tmp_path):
    package(tmp_path, "DP-1")
    package(tmp_path, "DP-2", digest="0" * 64)
    engine = Engine(spark, str(tmp_path))
    issues = {r["doc_id"]: r["issues"] for r in engine.packages().collect()}
    assert issues == {"DP-1": [], "DP-2": ["markdown hash differs"]}
    got = engine.identify(model)
    candidates = got["candidates"].collect()
    assert [c["candidate_id"] for c in candidates] == ["p1"] and len(json.loads(candidates[0]["content"])["items"]) == 2
    assert got["rejected_claims"].count() == 0 and got["calls"].where("not ok").count() == 0


def test_calls_are_retried_and_fail_closed(spark):
    requests = spark.createDataFrame([("a", "p", "good"), ("b", "p", "cut"), ("c", "p", "down")], "request_id string, purpose string, prompt string")

    def gateway(purpose, prompt):
        if prompt == "down":
            raise TimeoutError("slow")
        return {"content": "{}", "truncated": prompt == "cut"}

    rows = gateways.complete(requests, gateway, retries=1, partitions=1).collect()
    assert sorted((r["request_id"], r["attempt"], r["ok"]) for r in rows) == [("a", 1, True), ("b", 1, False), ("c", 1, False), ("c", 2, False)]


def test_embeddings_settings_and_ids(spark, tmp_path):
    units = spark.createDataFrame([(f"text {i}",) for i in range(7)], "retrieval_text string")
    got = gateways.embed(units, hashing_embedder(8), 8, 3).where(F.size("embedding") == 8)
    assert got.count() == 7
    assert Settings.load({"CLAIMFORGE_CONCURRENCY": "4"}).concurrency == 4
    for bad in ({"CLAIMFORGE_CONCURRENCY": "9"}, {"CLAIMFORGE_SEGMENT_CHARS": "1"}):
        try:
            Settings.load(bad)
            raise AssertionError("out of bounds")
        except ValueError:
            pass
    assert Engine(spark, str(tmp_path)).evaluation("none").first()[0] == ""


def test_stream_of_packages(spark, tmp_path):
    from claimforge.streaming.ingest import ingest, manifest_stream

    package(tmp_path, "DP-1")
    package(tmp_path, "DP-2")
    seen = []
    ingest(manifest_stream(spark, str(tmp_path)), lambda batch, n: seen.extend(r["document_package_id"] for r in batch.collect()), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(seen) == ["DP-1", "DP-2"] and read_manifests(spark, str(tmp_path)).count() == 2


def test_every_query_has_a_callable():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50
