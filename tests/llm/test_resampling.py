"""Importance resampling held against strings, zlib and a sort."""

import hashlib
import math
import re
import zlib

import numpy as np

from tests.llm.conftest import rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    seen = [(k, *buckets_of(x)) for k, x in docs]
    for _, _, f in seen:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, buckets_of(x)[1], 1)
    all_s, all_t = int(s.sum()) + 10000, int(t.sum()) + 10000
    gain = [math.floor(1000 * math.log((int(b) + 1) * all_s / ((int(a) + 1) * all_t))) for a, b in zip(s, t)]
    rows = []
    for k, n, f in seen:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r) for r in rows), key=str)


def test_equals_plain(spark, documents, odd):
    from llm.resampling import resample

    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [r["text"] for r in target.collect()]
    clashing = documents.withColumn("rank", documents.n_chars).withColumn("weight", documents.n_chars)
    for df in (documents, odd, documents.unionByName(documents.limit(150)), clashing):
        got = sorted((tuple(r) for r in resample(df, target).collect()), key=str)
        assert got == plain(rows_of(df), texts)


def test_crc_of_long_words_and_runs():
    from llm.resampling import shifts

    by, rng = shifts(), np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 2, 47, 48, 49, 63, 64, 65, 66, 1000, 70001)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    crc = by.words(data, end - [len(w) for w in words], end)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    for a, ca in zip(words, crc):
        n = np.array([len(w) for w in words])
        got = by.after(np.full(len(words), ca, np.uint32), n) ^ crc
        assert got.tolist() == [zlib.crc32(a + w) for w in words]


def test_draw_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from llm.resampling import draw

    scored = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("n_features"), F.lit(1).cast("long").alias("weight"), (F.col("id") * 7919 % 40).alias("score"), (F.col("id") % 30).alias("n_words"))
    spark.conf.set("spark.sql.shuffle.partitions", 17)
    try:
        got = draw(scored, (37, 100), 20).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    able = sorted((r for r in got if r["n_words"] >= 20), key=lambda r: (-r["score"], r["doc_id"]))
    want = {r["doc_id"]: i + 1 for i, r in enumerate(able[: 37 * len(able) // 100])}
    assert len(got) == 5000 and {r["doc_id"]: r["rank"] for r in got if r["rank"] is not None} == want


def test_empty(spark, empty, documents):
    from llm.resampling import resample

    assert resample(empty, documents).count() == 0
    assert resample(documents, empty).count() == documents.count()
