"""Scratch tables on the cluster's shared folder, and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side is broadcast only when it was counted and is within this many bytes; beyond it joins shuffle.
BROADCAST_BYTES = 12 << 20
BATCH, ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set (tests), a folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes) -> DataFrame:
    """`df` with a broadcast hint if its rows, at `row_bytes` (a number or a column) each, stay within BROADCAST_BYTES;
    `df` itself otherwise."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Rows go to workers ROWS_PER_BATCH at a time, unless the session says otherwise: ten thousand
    texts (Spark's default) would be tens of MB on both sides of the pipe for each running task."""
    if spark.conf.get(BATCH, None) in (None, "10000"):
        spark.conf.set(BATCH, ROWS_PER_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5


def power_of_two(n: float) -> int:
    p = 1
    while p < n:
        p *= 2
    return p
