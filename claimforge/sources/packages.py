"""Document packages, gold files, reports and plain tables as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ANCHOR = T.ArrayType(T.StructType([T.StructField("anchorId", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("page", T.IntegerType())]))
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("documentPackageId", "workspaceId", "sourceFileName", "sourceFilePath", "sourceSha256", "fullMarkdownPath", "fullMarkdownSha256", "processingMethod", "status")] + [T.StructField("anchors", ANCHOR), T.StructField("qualityIssues", T.ArrayType(T.StringType()))])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def snake(df: DataFrame) -> DataFrame:
    """camelCase columns as snake_case."""
    import re

    return df.select([F.col(c).alias(re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", c).lower()) for c in df.columns])


def camel(df: DataFrame) -> DataFrame:
    """snake_case columns as camelCase, for JSON messages."""
    parts = lambda c: c.split("_")
    return df.select([F.col(c).alias(parts(c)[0] + "".join(p.capitalize() for p in parts(c)[1:])) for c in df.columns])


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """documents/*/manifest.json under `root`; the last of equal package ids by path wins."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/documents/*/manifest.json").withColumn("path", F.col("_metadata.file_path"))
    last = raw.groupBy("documentPackageId").agg(F.max_by(F.struct(*[c for c in raw.columns if c != "documentPackageId"]), "path").alias("m"))
    return snake(last.select("documentPackageId", "m.*"))


def safe_path(root, path):
    """The path stays under the root: relative, and no step goes up."""
    return F.coalesce(~F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.rlike(r"^[a-zA-Z]+:"), F.lit(False)) & F.lit(bool(root))


def package_files(manifests: DataFrame, root: str) -> list[str]:
    """The files that one package's manifest names, if they stay under the root."""
    row = manifests.select("source_file_path", "full_markdown_path", (safe_path(root, F.col("source_file_path")) & safe_path(root, F.col("full_markdown_path"))).alias("safe")).first()
    return sorted({f"{root.rstrip('/')}/{p}" for p in (row["source_file_path"], row["full_markdown_path"]) if p}) if row is not None and row["safe"] else []


def load_packages(spark: SparkSession, root: str, manifests: DataFrame, package_id: str | None = None) -> DataFrame:
    """Manifests with `full_markdown` and `issues`: unsafe or missing files and hashes that differ become rows with issues.
    With `package_id` only that package's manifest row and the two files it names are read."""
    if package_id is None:
        binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/documents").select(F.col("path"), "content")
    else:
        manifests = manifests.where(F.col("document_package_id") == package_id)
        binary = spark.createDataFrame([], "path string, content binary")
        for file in package_files(manifests, root):
            try:
                binary = binary.unionByName(spark.read.format("binaryFile").load(file).select("path", "content"))
            except AnalysisException as error:
                if "PATH_NOT_FOUND" not in str(error):  # a missing file is an issue of its row
                    raise
    base = F.lit(root.rstrip("/") + "/")
    at = lambda c: F.regexp_replace(F.concat(base, F.col(c)), r"^file:/+", "/")
    files = binary.select(F.regexp_replace("path", r"^file:/+", "/").alias("file"), F.sha2("content", 256).alias("digest"), "content")
    source, text = files.select(F.col("file").alias("sf"), F.col("digest").alias("sd")), files.select(F.col("file").alias("mf"), F.col("digest").alias("md"), F.decode("content", "UTF-8").alias("full_markdown"))
    joined = manifests.join(source, at("source_file_path") == F.col("sf"), "left").join(text, at("full_markdown_path") == F.col("mf"), "left")
    issue = lambda bad, words: F.when(bad, F.lit(words))
    issues = F.array_compact(
        F.array(
            issue(~safe_path(root, F.col("source_file_path")) | ~safe_path(root, F.col("full_markdown_path")), "path leaves the workspace"),
            issue(F.col("sd").isNull() | F.col("md").isNull(), "file is missing"),
            issue(F.col("sd") != F.lower("source_sha256"), "source hash differs"),
            issue(F.col("md") != F.lower("full_markdown_sha256"), "markdown hash differs"),
            issue(F.col("status") != "available", "package is not available"),
        )
    )
    return joined.withColumn("issues", issues).drop("sf", "sd", "mf", "md")


def read_gold(spark: SparkSession, *roots: str) -> DataFrame:
    """For each package folder the newest gold-v*.json; earlier roots come first; files without groups are skipped."""
    found = None
    for i, root in enumerate(roots):
        one = spark.read.text(f"{root}/*/gold-v*.json", wholetext=True).select(F.lit(i).alias("priority"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("gold"))
        found = one if found is None else found.unionByName(one)
    usable = found.where(F.json_array_length(F.get_json_object("gold", "$.expectedObjectGroups")).isNotNull())
    parts = usable.withColumn("package_id", F.element_at(F.split("path", "/"), -2)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return parts.groupBy("package_id").agg(F.max_by(F.struct("name", "gold"), F.struct(F.negative("priority"), "name")).alias("g")).select("package_id", "g.name", "g.gold")


def read_report(spark: SparkSession, root: str, report_id: str) -> DataFrame:
    """An evaluation report's Markdown; an id of other characters than letters, digits, _ and - is refused, a missing one is empty."""
    import re

    if not re.fullmatch(r"[A-Za-z0-9_-]+", report_id):
        raise ValueError("bad report id")
    empty = spark.createDataFrame([("",)], "value string")
    try:
        return spark.read.text(f"{root}/{report_id}.md", wholetext=True).agg(F.coalesce(F.first("value"), F.lit("")).alias("value"))
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
