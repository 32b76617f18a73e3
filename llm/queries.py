"""The queries of this subpackage: thin `opN_<name>` wrappers that read whole tables and give the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.shared import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(
    r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)"""
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query()
def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.id_files import write_ids

    return write_ids(table(spark, sf_dir, "documents"), word_tokenizer()).read()


@query()
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


@query()
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.encode import tokenizer_text
    from llm.token_counts import byte_level_pieces, token_counts

    return token_counts(table(spark, sf_dir, "documents"), byte_level_pieces(tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))))


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.quality import score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


@query()
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.lm_score import lm_score

    return lm_score(table(spark, sf_dir, "documents"))


@query()
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from llm.byte_bpe import read_ranks, round_trip

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query()
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


@query(
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
