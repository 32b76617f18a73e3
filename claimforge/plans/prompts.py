"""Prompts for the model calls of each stage, as column expressions over batches of claims and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimforge.operators.claims import compact_prompt
from claimforge.rules import COVERAGE, RuleSet, render_contracts

PURPOSES = ("discover", "discover_and_plan", "plan", "coverage_repair", "realize", "content_repair", "json_repair")


def discovery(segments: DataFrame) -> DataFrame:
    """(request_id, purpose, prompt) for each segment: find atomic claims with verbatim evidence."""
    head = "Find the atomic claims of the text. Answer with a JSON object {\"claims\": [...]}. Kinds: " + ", ".join(COVERAGE) + ". Quote evidence verbatim and name its anchor.\n\n"
    return segments.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("index").cast("string")).alias("request_id"), F.lit("discover").alias("purpose"), F.concat(F.lit(head), F.col("label"), F.lit("\n"), F.col("markdown")).alias("prompt"))


def planning(claims_with_batch: DataFrame, rules: RuleSet, purpose: str = "plan") -> DataFrame:
    more = ', "planAugmentations": [{"planId", "sourceClaimIds"}]' if purpose == "coverage_repair" else ""
    head = "Assign each claim to object plans. Answer with {\"objectPlans\": [...]" + more + ", \"weakSignals\": [], \"unresolvedItems\": []}.\n" + render_contracts(rules) + "\n\nClaims:\n"
    small = compact_prompt(claims_with_batch)
    rows = small.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.to_json(F.struct("claim_id", "claim_kind", "statement", "subject", "attributes", "evidence", "source_text")).alias("j")))), lambda x: x["j"]), "\n").alias("list"))
    return rows.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("batch").cast("string")).alias("request_id"), F.lit(purpose).alias("purpose"), F.concat(F.lit(head), "list").alias("prompt"))


def json_repair(content: str) -> str:
    """Asks for an answer that is no JSON object once more, as one."""
    return "The text below was to be one JSON object of the requested shape and isn't. Give the same content as one valid JSON object, with nothing around it.\n\n" + content


def realization(plans_with_batch: DataFrame, claims: DataFrame, rules: RuleSet, purpose: str = "realize") -> DataFrame:
    """Plans of a batch with the contracts they need and only the claims they name."""
    head = "Write the content of each plan. Answer with {\"realizations\": [...]}; every value needs a claimUsage path.\n" + render_contracts(rules) + "\n\n"
    named = plans_with_batch.select("doc_id", "batch", F.explode("claim_ids").alias("claim_id")).distinct().join(claims.drop("pos"), ["doc_id", "claim_id"])
    said = named.groupBy("doc_id", "batch").agg(F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct("claim_id", "claim_kind", "statement", "subject", "attributes", "evidence")))), "\n").alias("claims"))
    asked = plans_with_batch.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.to_json(F.struct("plan_id", "title", "module", "object_type", "identity_hints", "claim_ids")).alias("j")))), lambda x: x["j"]), "\n").alias("plans"))
    return asked.join(said, ["doc_id", "batch"], "left").select(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("batch").cast("string")).alias("request_id"), F.lit(purpose).alias("purpose"), F.concat_ws("\n", F.lit(head + "Plans:"), "plans", F.lit("Claims:"), "claims").alias("prompt"))
