"""Source comparison, confidence and reasoning records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import compare, reason
from . import sql as S
from .inputs import Inputs
from .registry import query
from .retrieval import gathered, investigated, with_research

_TOKEN_HASH = "sha256(array_to_string(list_sort(t), ' '))"


@query(
    "source_tokens",
    "F1",
    S.with_("sources", f"SELECT query_id, source, CAST(first_rank AS BIGINT) AS first_rank, len(t) AS n_tokens, {_TOKEN_HASH} AS tokens_hash FROM sources"),
)
def source_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare.source_tokens(gathered(Inputs(spark, sf)).retrieved)
    return rows.select(
        "query_id", "source",
        F.col("first_rank").cast("long").alias("first_rank"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.array_sort("tokens"), " "), 256).alias("tokens_hash"),
    )


def _pairs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in ("position_a", "position_b")})


_PAIR = "query_id, position_a, position_b, source_a, source_b, " + S.six("overlap") + " AS overlap_ratio, CASE WHEN overlap >= 0.3 THEN 'agreement' ELSE 'divergence' END AS relation"


@query("compare_sources", "F2", S.with_("pairs", f"SELECT {_PAIR} FROM pairs"))
def compare_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(compare.compare_sources(gathered(Inputs(spark, sf)).retrieved))


@query(
    "divergence_counts",
    "F3",
    S.with_("clear pairs", "SELECT query_id, count(p.query_id) FILTER (overlap < 0.3) AS divergent_phrasing_count FROM clear LEFT JOIN pairs p USING (query_id) GROUP BY 1"),
)
def divergence_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = gathered(Inputs(spark, sf))
    return compare.divergence_counts(found.queries, compare.compare_sources(found.retrieved))


_REFS = (
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS position, source, document_id, title, source_type, url FROM (SELECT query_id, source, min(rank) AS r, "
    "arg_min(document_id, rank) AS document_id, arg_min(title, rank) AS title, arg_min(source_type, rank) AS source_type, arg_min(url, rank) AS url FROM skey GROUP BY 1, 2)"
)


@query("references", "F4", S.with_("skey", _REFS))
def references(spark: SparkSession, sf: str) -> DataFrame:
    found = compare.references(gathered(Inputs(spark, sf)).retrieved)
    return found.withColumn("position", F.col("position").cast("long"))


_FOUND_KEY = "SELECT *, coalesce(nullif(document_id, ''), nullif(url, ''), chunk_id) AS source FROM found"
_FOUND_SOURCES = (
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS p FROM (SELECT query_id, source, min(rank) AS first_rank, "
    + S.tokens("string_agg(chunk_text, ' ')") + " AS t FROM skey GROUP BY 1, 2)"
)


@query(
    "source_map",
    "F5",
    with_research(
        "SELECT query_id, 'node' AS part, coalesce(nullif(document_id, ''), url) AS a, title AS b, CASE WHEN source_type = 'web' THEN 'document' ELSE 'concept' END AS kind FROM refs "
        "UNION ALL SELECT query_id, 'edge', source_a, source_b, CASE WHEN overlap >= 0.3 THEN 'agreement' ELSE 'divergence' END FROM pairs",
        skey=_FOUND_KEY, sources=_FOUND_SOURCES, pairs=S.FRAGMENTS["pairs"][1], refs=_REFS,
    ),
)
def source_map(spark: SparkSession, sf: str) -> DataFrame:
    done = investigated(Inputs(spark, sf))
    nodes, edges = compare.source_map(done.references, done.comparisons)
    return nodes.select(
        "query_id", F.lit("node").alias("part"), F.col("node_id").alias("a"), F.col("name").alias("b"), F.col("node_type").alias("kind")
    ).unionByName(
        edges.select(
            "query_id", F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("relationship_type").alias("kind")
        )
    )


@query(
    "confidence",
    "G1",
    S.with_(
        "reasons",
        f"SELECT query_id, {S.six('s1')} AS source_availability, agreement AS agreement_among_sources, {S.six('s3')} AS reasoning_completeness, {S.six('s4')} AS context_quality, {S.six('s5')} AS retrieval_quality, overall FROM reasons",
    ),
)
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = gathered(Inputs(spark, sf)).reasons
    return rows.select(
        "query_id", "source_availability", "agreement_among_sources", "reasoning_completeness", "context_quality", "retrieval_quality", "overall"
    )


@query(
    "research_confidence",
    "G2",
    with_research(
        f"SELECT a.query_id, {S.six('least(1.0, count(f.rank) / 3)')} AS source_availability, 1.0::DOUBLE AS agreement_among_sources, CASE WHEN count(f.rank) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reasoning_completeness, "
        f"1.0::DOUBLE AS context_quality, {S.six('coalesce(avg(f.score), 0.0)')} AS overall FROM asked a LEFT JOIN found f USING (query_id) GROUP BY 1"
    ),
)
def research_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return investigated(Inputs(spark, sf)).confidence.select(
        "query_id", "source_availability", "agreement_among_sources", "reasoning_completeness", "context_quality", "overall"
    )


@query(
    "reasoning_conclusion",
    "G7",
    S.with_(
        "reasons",
        "SELECT query_id, message AS problem, chunk_ids[1] AS primary_chunk_id, n_rel AS supporting_relationship_count, coalesce(array_to_string(chunk_ids, '|'), '') AS inference, "
        "coalesce(array_to_string(chunk_ids[2:], '|'), '') AS alternatives FROM reasons",
    ),
)
def reasoning_conclusion(spark: SparkSession, sf: str) -> DataFrame:
    return gathered(Inputs(spark, sf)).reasons.select(
        "query_id", "problem", "primary_chunk_id",
        F.col("n_relationships").alias("supporting_relationship_count"),
        F.array_join("inference", "|").alias("inference"),
        F.array_join("alternatives", "|").alias("alternatives"),
    )


@query(
    "facts_and_evidence",
    "G8",
    S.with_(
        "retrieved",
        "SELECT query_id, rank, chunk_id, sha256(chunk_text) AS fact, document_id AS source_document_id, title AS source_document_title, source_type, url AS source_url, concept_id, score FROM retrieved",
    ),
)
def facts_and_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = gathered(Inputs(spark, sf)).retrieved
    facts = reason.facts(found).select("query_id", "rank", F.sha2("text", 256).alias("fact"))
    return reason.evidence_records(found).join(facts, ["query_id", "rank"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    "assumptions_and_constraints",
    "B14 B15",
    S.with_(
        "reasons",
        "SELECT query_id, CASE WHEN n = 0 THEN 'no_retrieved_evidence' WHEN n < 3 THEN 'limited_source_coverage' ELSE '' END AS assumptions, "
        "CASE WHEN max_tokens > 0 AND total_tokens >= max_tokens THEN 'context_token_budget_reached' ELSE '' END AS constraints FROM reasons",
        budget=1500,
    )
    + " UNION ALL SELECT 'doc' || doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no_retrieved_evidence' WHEN doc_id % 5 < 3 THEN 'limited_source_coverage' ELSE '' END, "
    "CASE WHEN doc_id % 3 > 0 AND n_chars >= doc_id % 3 * 300 THEN 'context_token_budget_reached' ELSE '' END FROM documents",
)
def assumptions_and_constraints(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    rows = gathered(i, max_tokens=1500).reasons.select("query_id", "assumptions", "constraints")
    made = i.table("documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("query_id"),
        reason.assumptions(F.col("doc_id") % 5).alias("assumptions"),
        reason.constraints(F.col("n_chars"), F.col("doc_id") % 3 * 300).alias("constraints"),
    )
    return rows.unionByName(made).select(
        "query_id", F.array_join("assumptions", "|").alias("assumptions"), F.array_join("constraints", "|").alias("constraints")
    )
