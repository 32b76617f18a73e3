"""Model and embedding calls as DataFrame sources: an injected callable runs in Arrow batches on the executors.

Calls aren't deterministic, so callers materialise the result before using it twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

NO_OBJECT = "answer is not a JSON object"
CALLS = "request_id string, purpose string, attempt int, ok boolean, truncated boolean, content string, error string, prompt_tokens long, completion_tokens long, duration_ms long"


def complete(requests: DataFrame, gateway: Callable[[str, str], dict], retries: int = 1, partitions: int = 3, repair_prompt: Callable[[str], str] | None = None) -> DataFrame:
    """One row for each attempt of each (request_id, purpose, prompt): failures are rows, not exceptions.

    gateway(purpose, prompt) gives {"content", "promptTokens", "completionTokens", "truncated"}. Content must be a JSON
    object. Text that isn't one gets a single repair call, a row of its own of the purpose "json_repair" whose content stands
    for the request's; a truncated answer fails closed, with no repair."""

    def call(rid: str, purpose: str, prompt: str, attempt: int) -> tuple:
        began, answer, error = time.time(), {}, None
        try:
            answer = gateway(purpose, prompt)
            if answer.get("truncated"):
                error = "output limit reached"
            elif not is_object(answer.get("content")):
                error = NO_OBJECT
        except Exception as problem:
            error = f"{type(problem).__name__}: {problem}"
        return (rid, purpose, attempt, error is None, bool(answer.get("truncated")), answer.get("content"), error, answer.get("promptTokens") or 0, answer.get("completionTokens") or 0, int(1000 * (time.time() - began)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, purpose, prompt in batch[["request_id", "purpose", "prompt"]].itertuples(index=False):
                for attempt in range(1, retries + 2):
                    rows.append(call(rid, purpose, prompt, attempt))
                    _, _, _, ok, truncated, content, error, *_ = rows[-1]
                    if error == NO_OBJECT and repair_prompt:
                        rows.append(call(rid, "json_repair", repair_prompt(content or ""), attempt + 1))
                        break
                    if ok or truncated:
                        break
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALLS.split(", ")])

    return requests.repartition(partitions).mapInPandas(run, CALLS)


def is_object(text) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (TypeError, ValueError):
        return False


def trace(calls: DataFrame) -> DataFrame:
    """Calls numbered call-001.. for each document in order, with the call that each repeats."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("group_pos", "attempt")
    numbered = calls.withColumn("call_id", F.format_string("call-%03d", F.row_number().over(order)))
    return numbered.withColumn("retry_of", F.when(F.col("attempt") > 1, F.lag("call_id").over(Window.partitionBy("document_id", "group_pos").orderBy("attempt"))))


def usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("purpose").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("duration_ms").alias("duration_ms"), F.count_if(~F.col("ok")).alias("failures"))


def embed(units: DataFrame, embedder: Callable[[list[str]], list[dict]], dimension: int, batch: int = 10) -> DataFrame:
    """`units` with `embedding`: slices of `batch` texts, put in order by index, counts and dimensions checked."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for i in range(0, len(texts), batch):
                part = texts.iloc[i : i + batch].tolist()
                rows = sorted(embedder(part), key=lambda r: r["index"])
                if [r["index"] for r in rows] != list(range(len(part))) or any(len(r["embedding"]) != dimension for r in rows):
                    raise ValueError("the embedding service gave other vectors than asked for")
                out += [r["embedding"] for r in rows]
            yield pd.Series(out)

    return units.withColumn("embedding", run(F.col("retrieval_text")))
