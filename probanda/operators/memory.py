"""Tiered memory records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as T

TIERS = V.EPHEMERAL_TIERS + V.PERSISTENT_TIERS


def remember(interactions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """interactions(interaction_id, content, tier, scope_id, metadata, created_at) to
    (records, rejected, events).

    Emptiness is tested before the strip, so a blank text is stored as an empty one.
    """
    tier = F.coalesce("tier", F.lit("working"))
    problem = F.when(F.coalesce("content", F.lit("")) == "", "empty_content").when(
        ~tier.isin(TIERS), "unknown_tier"
    )
    checked = interactions.withColumn("reject_reason", problem)
    records = checked.where("reject_reason is null").select(
        T.stable_id(F.lit("memory"), F.col("interaction_id")).alias("id"),
        tier.alias("tier"),
        "scope_id",
        T.strip(F.col("content")).alias("content"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        "created_at",
        tier.isin(V.PERSISTENT_TIERS).alias("persistent"),
    )
    rejected = checked.where("reject_reason is not null").select("interaction_id", "content", "tier", "reject_reason")
    events = records.select(
        F.lit("MemoryUpdated").alias("name"),
        F.to_json(F.struct(F.col("id").alias("memory_id"), "tier", "scope_id")).alias("payload"),
    )
    return records, rejected, events


def write_memory(records: DataFrame, persistent_path: str, run_path: str) -> None:
    """Persistent tiers to the memory table, the others to this run's folder."""
    for kept, path in ((True, persistent_path), (False, run_path)):
        records.where(F.col("persistent") == kept).drop("persistent").write.mode("append").partitionBy("tier").parquet(path)


def recall(memory: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(tier, id): a record is found only under its own tier."""
    return memory.join(wanted.select("tier", "id").distinct(), ["tier", "id"], "left_semi")


def research_interactions(answers: DataFrame, parts: DataFrame, refs: DataFrame) -> DataFrame:
    """Research answers as interactions, with question, parts and references as metadata.

    answers(query_id, query, synthesized_answer, created_at), parts(question_id, part,
    query), refs as from ``compare.references``.
    """
    listed = parts.groupBy(F.col("question_id").alias("query_id")).agg(
        F.array_sort(F.collect_list(F.struct("part", "query"))).alias("p")
    ).select("query_id", F.transform("p", lambda x: x["query"]).alias("sub_questions"))
    cited = refs.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "document_id", "title", "source_type", "url"))).alias("r")
    ).select("query_id", F.transform("r", lambda x: x.dropFields("position")).alias("references"))
    rows = answers.join(listed, "query_id", "left").join(cited, "query_id", "left")
    metadata = F.struct(
        F.col("query").alias("question"),
        "sub_questions",
        F.coalesce("references", F.array().cast("array<struct<document_id:string,title:string,source_type:string,url:string>>")).alias("references"),
    )
    return rows.select(
        F.concat_ws("|", F.lit("research"), "query_id").alias("interaction_id"),
        F.col("synthesized_answer").alias("content"),
        F.lit("research").alias("tier"),
        F.lit(None).cast("string").alias("scope_id"),
        F.to_json(metadata).alias("metadata"),
        "created_at",
    )
