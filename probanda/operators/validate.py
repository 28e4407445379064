"""Checks of a response against its evidence: native columns on one joined row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as T




def _text_array(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _format(pattern: str, *values: Column) -> Column:
    pieces = pattern.split("%s")
    out = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value, F.lit(piece)]
    return F.concat(*out)


def citation_violations(response: Column, known: Column) -> Column:
    unknown = F.filter(T.citations(response), lambda c: ~F.array_contains(known, c))
    return F.transform(unknown, lambda c: _format(V.CITATION_VIOLATION, c))


def consistency_violations(response: Column, overall: Column) -> Column:
    off = F.filter(T.confidence_claims(response), lambda c: F.abs(c - overall) > V.CONFIDENCE_TOLERANCE)
    return F.transform(
        off, lambda c: _format(V.CLAIM_VIOLATION, T.two_decimals(c), T.two_decimals(overall))
    )


def confidence_violations(response: Column, overall: Column) -> Column:
    hedged = T.contains_any(F.lower(response), V.UNCERTAINTY_MARKERS)
    message = _format(V.HEDGE_VIOLATION, T.two_decimals(overall))
    return _text_array(F.when((overall < V.LOW_CONFIDENCE) & ~hedged, message))


def completeness_violations(response: Column, n_evidence: Column) -> Column:
    told = T.contains_any(F.lower(response), V.NO_EVIDENCE_MARKERS)
    return _text_array(F.when((n_evidence == 0) & ~told, F.lit(V.COMPLETENESS_VIOLATION)))


def reflection_flags(response: Column, n_evidence: Column, agreement: Column) -> Column:
    lowered = F.lower(response)
    none = n_evidence == 0
    conflict = (agreement < V.LOW_AGREEMENT) & (n_evidence > 1)
    return _text_array(
        F.when(none & ~T.contains_any(lowered, V.NO_EVIDENCE_MARKERS), F.lit("insufficient_evidence_not_acknowledged")),
        F.when(none & ~T.contains_any(lowered, V.EXPOSED_UNCERTAINTY_MARKERS), F.lit("uncertainty_not_exposed")),
        F.when(conflict & ~T.contains_any(lowered, V.CONFLICT_MARKERS), F.lit("forced_synthesis_risk")),
    )


def verdicts(responses: DataFrame, reasons: DataFrame) -> DataFrame:
    """responses(query_id, response_text) ⋈ reasons(query_id, known_sources, n_chunks,
    overall, agreement_among_sources)."""
    rows = responses.select("query_id", "response_text").join(
        reasons.select("query_id", "known_sources", "n_chunks", "overall", "agreement_among_sources"), "query_id"
    )
    text, overall, n = F.col("response_text"), F.col("overall"), F.col("n_chunks")
    kinds = {
        "citation_violations": citation_violations(text, F.col("known_sources")),
        "consistency_violations": consistency_violations(text, overall),
        "confidence_violations": confidence_violations(text, overall),
        "completeness_violations": completeness_violations(text, n),
    }
    return (
        rows.withColumns(kinds)
        .withColumn("failure_flags", reflection_flags(text, n, F.col("agreement_among_sources")))
        .withColumn("all_violations", F.concat(*kinds))
        .withColumns(
            {
                "validation_passed": F.size("all_violations") == 0,
                "reflection_passed": F.size("failure_flags") == 0,
            }
        )
        .withColumn("delivered", F.col("validation_passed") & F.col("reflection_passed"))
        .drop("known_sources", "n_chunks", "agreement_among_sources")
    )


def delivered_chat(checked: DataFrame) -> DataFrame:
    """Chat text that failed a check is withheld."""
    return checked.withColumn("delivered_text", F.when(F.col("delivered"), F.col("response_text")))


def delivered_research(checked: DataFrame, prompts: DataFrame) -> DataFrame:
    """Research text that failed is replaced; a question without chunks has its fixed
    answer, which is not checked."""
    rows = prompts.select("query_id", "answer").join(checked, "query_id", "left")
    fixed = F.col("answer").isNotNull()
    return rows.select(
        "query_id",
        (fixed | F.coalesce("delivered", F.lit(False))).alias("delivered"),
        F.when(fixed, F.col("answer"))
        .when(F.col("delivered"), F.col("response_text"))
        .otherwise(V.RESEARCH_FALLBACK_TEXT)
        .alias("synthesized_answer"),
        F.when(fixed | F.col("all_violations").isNull(), F.array().cast("array<string>"))
        .otherwise(F.concat("all_violations", "failure_flags"))
        .alias("violations"),
    )


def violation_report(checked: DataFrame) -> DataFrame:
    """Messages and affected responses by kind."""
    kinds = ["citation_violations", "consistency_violations", "confidence_violations", "completeness_violations", "failure_flags"]
    sizes = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(k).alias("n")) for k in kinds])
    rows = checked.select(F.explode(sizes).alias("k"))
    return rows.groupBy(F.col("k.kind").alias("kind")).agg(
        F.sum("k.n").alias("messages"),
        F.count_if(F.col("k.n") > 0).alias("responses"),
    )
