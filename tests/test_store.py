"""Versions of the store: parts of one package, races, and reads that touch only what they need."""

import pytest
from pyspark.sql import functions as F

from claimforge.operators.dml import LostRace, Store, bucket
from claimforge.sources.packages import load_packages, read_manifests
from tests.test_engine import package

SOURCES = "knowledge_object_id string, document_package_id string, run_id string, candidate_id string, active boolean"


def sources(spark, rows):
    return spark.createDataFrame([(k, p, r, "c", True) for k, p, r in rows], SOURCES)


def test_only_the_touched_bucket_is_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    names = [f"P{i}" for i in range(20)]
    assert store.version() == 0 and store.current() == {}
    assert store.write({"object_sources": sources(spark, [(f"k{i}", n, "r1") for i, n in enumerate(names)]), "entities": spark.createDataFrame([("b",)], "entity_id string")}) == 1
    before = store.current()
    assert set(before["object_sources"]) == {str(bucket(n)) for n in names}
    mine = store.read("object_sources").withColumn("active", F.col("document_package_id") != "P3").unionByName(sources(spark, [("new", "P3", "r2")]))
    store.write({"object_sources": mine}, "P3")
    after = store.current()
    assert {k for k in before["object_sources"] if before["object_sources"][k] != after["object_sources"][k]} == {str(bucket("P3"))}
    assert after["entities"] == before["entities"] and store.current(1) == before
    assert sorted((r["knowledge_object_id"], r["active"]) for r in store.read("object_sources", "P3").collect()) == [("k3", False), ("new", True)]
    assert store.read("object_sources").count() == 21 and store.read("object_sources").where("active").count() == 20
    store.write({"object_sources": sources(spark, [("x", "fresh", "r3")])}, "fresh")  # a package that had no rows
    assert store.read("object_sources", "fresh").count() == 1 and store.read("object_sources", "unheard").count() == 0


def test_a_package_is_read_from_its_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write({"object_sources": sources(spark, [(f"k{i}", f"P{i}", "r") for i in range(30)])})
    files = store.read("object_sources", "P7").inputFiles()
    assert files and all(f"bucket-{bucket('P7'):03d}" in f for f in files) and len(store.read("object_sources").inputFiles()) > len(files)
    plan = store.read("object_sources", "P7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(document_package_id), EqualTo(document_package_id,P7)]" in plan


def test_a_lost_race_raises(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.write({"object_sources": sources(spark, [("k", "P", "r1")])})
    base = one.version()
    assert two.version() == base
    one.write({"object_sources": sources(spark, [("k", "P", "r2")])}, "P", base)
    with pytest.raises(LostRace):
        two.write({"object_sources": sources(spark, [("k", "P", "r3")])}, "P", base)
    assert [r["run_id"] for r in one.read("object_sources").collect()] == ["r2"]


def test_one_package_reads_its_own_files(spark, tmp_path):
    for name in ("DP-1", "DP-2", "DP-3"):
        package(tmp_path, name, digest="0" * 64 if name == "DP-2" else None)
    root, manifests = str(tmp_path), read_manifests(spark, str(tmp_path))
    every = {r["document_package_id"]: r for r in load_packages(spark, root, manifests).collect()}
    for name in every:
        one = load_packages(spark, root, manifests, name)
        assert [tuple(r) for r in one.collect()] == [tuple(every[name])]
        files = [f for f in one.inputFiles() if not f.endswith("manifest.json")]
        assert files and all(f"/{name}/" in f for f in files)
    (tmp_path / "documents" / "DP-3" / "full.md").unlink()
    (gone,) = load_packages(spark, root, manifests, "DP-3").collect()
    assert gone["issues"] == ["file is missing"] and load_packages(spark, root, manifests, "none").count() == 0
