"""Intent, assumptions, facts, confidence and conclusion per query.

Every function starts from the query table and joins aggregates to its left, so a query
without evidence keeps its row: those are the rows later checks look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import intent as I
from ..functions import text as T
from .graph import retrieved_concepts


def evidence_summary(retrieved: DataFrame) -> DataFrame:
    """One pass over the retrieved rows of each query (bounded by its top_k)."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    names = F.flatten(F.collect_list(F.array("document_title", "document_id")))
    return retrieved.groupBy("query_id").agg(
        F.count("*").alias("n_chunks"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("spread"),
        F.min_by("score", "rank").alias("top_score"),
        F.transform(ranked, lambda r: r["chunk_id"]).alias("chunk_ids"),
        F.count_distinct(F.nullif("document_id", F.lit(""))).alias("n_documents"),
        F.bool_or(F.col("source_type") == "web").alias("has_web"),
        F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))).alias("known_sources"),
    )


def intents(queries: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Decision fields and plan; without ``evidence`` as read before retrieval."""
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    if evidence is None:
        rows = rows.withColumns({"n_chunks": F.lit(0), "top_score": F.lit(None).cast("double")})
    else:
        rows = rows.join(evidence.select("query_id", "n_chunks", "top_score"), "query_id", "left")
    fields = I.intent_columns(F.col("query"), F.col("n_chunks"), F.col("top_score"))
    return (
        rows.withColumns(fields)
        .withColumn("steps", I.plan_steps())
        .select("query_id", "query", *fields, "steps")
    )


def assumptions(n_chunks: Column) -> Column:
    return (
        F.when(n_chunks == 0, F.array(F.lit("no_retrieved_evidence")))
        .when(n_chunks < V.EXPECTED_SOURCES, F.array(F.lit("limited_source_coverage")))
        .otherwise(F.array().cast("array<string>"))
    )


def constraints(total_tokens: Column, max_tokens: Column) -> Column:
    full = (max_tokens > 0) & (total_tokens >= max_tokens)
    return F.when(full, F.array(F.lit("context_token_budget_reached"))).otherwise(
        F.array().cast("array<string>")
    )


def confidence_columns() -> dict[str, Column]:
    """Five sub-scores and their mean, from n_chunks, mean_score, spread,
    n_definitions, n_relationships, total_tokens and max_tokens of the same row."""
    n = F.col("n_chunks")
    mean, spread = F.col("mean_score"), F.col("spread")
    signals = [F.col("n_definitions") > 0, n > 0, F.col("n_relationships") > 0]
    availability = F.least(F.lit(1.0), n / V.EXPECTED_SOURCES)
    agreement = (
        F.when(n == 0, 0.0)
        .when(n == 1, 1.0)
        .when(mean > 0, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), spread / mean)))
        .otherwise(0.0)
    )
    completeness = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int")) / len(signals)
    fill = F.when(
        F.col("max_tokens") > 0, F.least(F.lit(1.0), F.col("total_tokens") / F.col("max_tokens"))
    ).otherwise(0.0)
    quality = F.when(n > 0, mean).otherwise(0.0)
    parts = {
        "source_availability": availability,
        "agreement_among_sources": agreement,
        "reasoning_completeness": completeness,
        "context_quality": fill,
        "retrieval_quality": quality,
    }
    overall = (availability + agreement + completeness + fill + quality) / 5
    return {k: T.six(v) for k, v in {**parts, "overall": overall}.items()}


def reasoning(
    queries: DataFrame,
    retrieved: DataFrame,
    concepts: DataFrame,
    edge_digest: DataFrame,
    budgets: DataFrame,
) -> DataFrame:
    """One row per query: evidence summary, counts, assumptions, constraints, confidence
    and conclusion.  ``edge_digest(concept_id, n_items)`` carries edge counts;
    ``budgets(query_id, total_tokens, max_tokens)`` comes from context packing."""
    per_concept = (
        retrieved_concepts(retrieved)
        .join(concepts.select(F.col("id").alias("concept_id"), F.lit(1).alias("exists")), "concept_id", "left")
        .join(edge_digest.select("concept_id", "n_items"), "concept_id", "left")
        .groupBy("query_id")
        .agg(
            F.count("exists").alias("n_definitions"),
            F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_relationships"),
        )
    )
    rows = (
        queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
        .join(evidence_summary(retrieved), "query_id", "left")
        .join(per_concept, "query_id", "left")
        .join(budgets.select("query_id", "total_tokens", "max_tokens"), "query_id", "left")
        .na.fill(0, ["n_chunks", "n_definitions", "n_relationships", "n_documents", "total_tokens", "max_tokens"])
        .na.fill(False, ["has_web"])
    )
    none = F.array().cast("array<string>")
    return (
        rows.withColumns(confidence_columns())
        .withColumns(
            {
                "problem": T.strip(F.col("query")),
                "known_sources": F.coalesce("known_sources", none),
                "inference": F.coalesce("chunk_ids", none),
                "assumptions": assumptions(F.col("n_chunks")),
                "constraints": constraints(F.col("total_tokens"), F.col("max_tokens")),
            }
        )
        .withColumns(
            {
                "primary_chunk_id": F.get("inference", F.lit(0)),
                "alternatives": F.slice("inference", 2, F.greatest(F.size("inference"), F.lit(1))),
            }
        )
        .drop("chunk_ids", "mean_score", "spread")
    )


def facts(retrieved: DataFrame) -> DataFrame:
    return retrieved.select("query_id", "rank", "chunk_id", F.col("chunk_text").alias("text"))


def evidence_records(retrieved: DataFrame) -> DataFrame:
    return retrieved.select(
        "query_id",
        "rank",
        "chunk_id",
        F.col("document_id").alias("source_document_id"),
        F.col("document_title").alias("source_document_title"),
        "source_type",
        F.col("url").alias("source_url"),
        "concept_id",
        "score",
    )


def research_confidence(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The simpler research form: overall confidence is the mean score."""
    rows = questions.select(F.col("query_id").cast("string").alias("query_id"), "query").join(
        evidence_summary(retrieved), "query_id", "left"
    ).na.fill(0, ["n_chunks", "n_documents"]).na.fill(False, ["has_web"])
    n = F.col("n_chunks")
    quality = T.six(F.when(n > 0, F.col("mean_score")).otherwise(0.0))
    return rows.select(
        "query_id",
        "query",
        "n_chunks",
        "n_documents",
        "has_web",
        F.coalesce("known_sources", F.array().cast("array<string>")).alias("known_sources"),
        T.six(F.least(F.lit(1.0), n / V.EXPECTED_SOURCES)).alias("source_availability"),
        F.lit(1.0).alias("agreement_among_sources"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("reasoning_completeness"),
        F.lit(1.0).alias("context_quality"),
        quality.alias("retrieval_quality"),
        quality.alias("overall"),
    )


def turn_summaries(queries: DataFrame, reasons: DataFrame, divergences: DataFrame) -> DataFrame:
    """Verification and context figures shown with an answer."""
    return (
        queries.select(F.col("query_id").cast("string").alias("query_id"))
        .join(reasons, "query_id", "left")
        .join(divergences, "query_id", "left")
        .select(
            "query_id",
            F.col("n_chunks").alias("sources_checked"),
            F.col("n_chunks").alias("evidence_count"),
            "divergent_phrasing_count",
            F.col("agreement_among_sources").alias("agreement_score"),
            F.col("overall").alias("confidence"),
            F.col("n_chunks").alias("retrieved_chunk_count"),
            F.col("n_documents").alias("document_count"),
            F.col("n_relationships").alias("concept_relationship_count"),
        )
    )
