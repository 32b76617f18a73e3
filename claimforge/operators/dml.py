"""Table changes on Parquet snapshots: upserts, deactivation, supersession and the formation commit.

Parquet has no MERGE, so a change is a DataFrame of the new state. `Store` writes a build to a new snapshot directory, of
tables that are keyed by package only the bucket that it touches, and publishes one version file last; readers see the old build or
the new one.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimforge.scratch import settle


def _maps(df: DataFrame) -> bool:
    """Whether a column holds maps or variants, which have no order."""
    return any(word in f.dataType.simpleString() for f in df.schema for word in ("map<", "variant"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of equal keys; columns in `keep` hold their old value where there is one. Of new rows that
    share a key one stands, the one that sorts last."""
    rest = [c for c in new.columns if c not in keys]
    new = (new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("last")).select(*keys, "last.*") if not _maps(new) else new.dropDuplicates(keys)).select(*new.columns) if rest else new.distinct()
    if not keep:
        return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    o = old.select(*[F.col(c).alias(f"old_{c}") if c not in keys else F.col(c) for c in old.columns], F.lit(True).alias("in_old"))
    n = new.withColumn("in_new", F.lit(True))
    both = o.join(n, keys, "full_outer")
    pick = lambda c: F.when(F.col("in_new").isNull() | (F.col("in_old").isNotNull() & F.lit(c in keep)), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*[F.col(c) if c in keys else pick(c) for c in old.columns])


def upsert_partial(old: DataFrame, new: DataFrame, keys: list[str], where_set: str) -> DataFrame:
    """Upsert under an index that covers only rows with `where_set`; rows without it never conflict."""
    hit = new.where(F.col(where_set).isNotNull()).select(*keys).distinct()
    return old.join(hit, keys, "left_anti").unionByName(new)


def append_with_ttl(old: DataFrame, new: DataFrame, hours: int, now: Column | None = None) -> DataFrame:
    """Drop expired rows, add the new ones with their time to live."""
    now = F.current_timestamp() if now is None else now
    return old.where(F.col("expires_at") > now).unionByName(new.withColumn("expires_at", now + F.make_dt_interval(hours=F.lit(hours))))


def deactivate(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("active", F.when(condition & F.col("active"), F.lit(False)).otherwise(F.col("active")))


def orphans(relationships: DataFrame, sources: DataFrame, key: str = "relationship_id") -> DataFrame:
    """Relationships without an active source; they become inactive."""
    alive = sources.where("active").select(key).distinct().withColumn("alive", F.lit(True))
    return relationships.join(alive, key, "left").withColumn("status", F.when(F.col("alive").isNull(), "inactive").otherwise(F.col("status"))).drop("alive")


def superseded(previous: DataFrame, current: DataFrame, sources: DataFrame, key: str = "knowledge_object_id") -> DataFrame:
    """Objects of an earlier build that the new one lacks and that no active source holds."""
    return previous.select(key).distinct().join(current.select(key), key, "left_anti").join(sources.where("active").select(key), key, "left_anti")


def dangling(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Referential audit: rows whose key the parent table lacks."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def commit_formation(tables: dict[str, DataFrame], build: dict[str, DataFrame], package_id: str, status: str) -> dict[str, DataFrame]:
    """The tables after one build of a package. A build under review changes build_results only."""
    out = dict(tables)
    out["build_results"] = upsert(tables["build_results"], build["build_results"], ["run_id"])
    if status == "review_required":
        return out
    previous = tables["object_sources"].where((F.col("document_package_id") == package_id) & F.col("active")).select("knowledge_object_id").distinct()
    for name in ("object_sources", "relationship_sources", "retrieval_units"):
        if name in tables:
            out[name] = deactivate(tables[name], F.col("document_package_id") == package_id)
    out["entities"] = upsert(tables["entities"], build["entities"], ["entity_id"], keep=("entity_type", "created_at"))
    out["objects"] = upsert(tables["objects"], build["objects"].withColumn("status", F.lit("active")), ["knowledge_object_id"], keep=("created_at",))
    out["object_sources"] = upsert_partial(out["object_sources"], build["object_sources"], ["knowledge_object_id", "document_package_id", "run_id", "candidate_id"], "run_id")
    out["lineages"] = upsert(tables["lineages"], build["lineages"], ["workspace_id", "source_lineage_key"])
    out["relationships"] = upsert(tables["relationships"], build["relationships"], ["relationship_id"])
    out["relationship_sources"] = upsert(out["relationship_sources"], build["relationship_sources"], ["relationship_id", "document_package_id", "run_id"])
    out["object_sources"], out["relationship_sources"] = settle(out["object_sources"]), settle(out["relationship_sources"])
    out["relationships"] = orphans(out["relationships"], out["relationship_sources"])
    gone = superseded(previous, build["objects"], out["object_sources"]).withColumn("gone", F.lit(True))
    out["objects"] = out["objects"].join(gone, "knowledge_object_id", "left").withColumn("status", F.when(F.col("gone"), "superseded").otherwise(F.col("status"))).drop("gone")
    return out


class LostRace(RuntimeError):
    """Another build has been committed since this one read its state."""


#: Tables whose rows belong to one package each, and the column that names it: they are kept in BUCKETS parts by package, and a
#: build writes its own part anew.
KEYED = {"object_sources": "document_package_id", "relationship_sources": "document_package_id", "retrieval_units": "doc_id", "build_results": "document_package_id"}
BUCKETS = 256


def bucket(package_id: str) -> int:
    return zlib.crc32(package_id.encode()) % BUCKETS


class Store:
    """Snapshots of named tables under one root. `versions/<n>.json` names the paths in force after the n-th commit, by table and,
    for KEYED tables, by bucket of packages: a bounded list. A version's file is created exclusively, so of two builds that read
    the same version one is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root if '://' in self.root else f'file://{self.root}'}/versions")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        where, path = self._fs()
        if not where.exists(path):
            return 0
        return max((int(name.split(".")[0]) for name in (f.getPath().getName() for f in where.listStatus(path)) if name.endswith(".json")), default=0)

    def current(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        where, path = self._fs()
        stream = where.open(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, package_id: str | None = None, version: int | None = None) -> DataFrame:
        """A table; of a KEYED one, with `package_id`, that package's rows out of its bucket alone."""
        paths = self.current(version)[name]
        if not isinstance(paths, dict):
            return self.spark.read.parquet(paths)
        if package_id is None:
            return self.spark.read.parquet(*[paths[k] for k in sorted(paths, key=int)])
        own = paths.get(str(bucket(package_id)))
        if own is None:
            return self.spark.read.parquet(paths[min(paths, key=int)]).where(F.lit(False))
        return self.spark.read.parquet(own).where(F.col(KEYED[name]) == package_id)

    def write(self, tables: dict[str, DataFrame], package_id: str | None = None, base: int | None = None) -> int:
        """Write the tables as a new version on top of `base` (the present one); tables not given stay as they are. With
        `package_id` only its bucket of KEYED tables is written: what the others hold must be unchanged in `tables`."""
        base = self.version() if base is None else base
        now, build = self.current(base), uuid.uuid4().hex
        for name, df in tables.items():
            if name not in KEYED:
                now[name] = f"{self.root}/{build}/{name}"
                df.write.parquet(now[name])
                continue
            held, number = now.get(name), F.crc32(F.coalesce(F.col(KEYED[name]).cast("string"), F.lit(""))) % BUCKETS
            if package_id is not None and isinstance(held, dict):
                parts = {bucket(package_id): df.where(number == bucket(package_id))}
            else:  # the first write, or one of all packages
                held, kept = {}, settle(df.withColumn("__bucket", number.cast("int")))
                parts = {r[0]: kept.where(F.col("__bucket") == r[0]).drop("__bucket") for r in kept.select("__bucket").distinct().collect()} or {0: df.limit(0)}
            for k, part in parts.items():
                path = f"{self.root}/{build}/{name}/bucket-{k:03d}"
                part.write.parquet(path)
                held[str(k)] = path
            now[name] = held
        self._publish(base + 1, now)
        return base + 1

    def _publish(self, version: int, paths: dict) -> None:
        where, path = self._fs()
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{version:012d}.json")
        try:
            stream = where.create(file, False)
        except Exception as error:
            if where.exists(file):
                raise LostRace(f"version {version} has been committed by another build") from error
            raise
        stream.write(json.dumps(paths).encode())
        stream.close()
