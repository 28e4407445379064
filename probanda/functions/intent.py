"""Rule-based reading of an utterance: native columns only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import strip, words


def _any_word(ws: Column, vocabulary: list[str]) -> Column:
    return F.arrays_overlap(ws, F.array(*[F.lit(w) for w in vocabulary]))


def asked_kind(query: Column) -> Column:
    lowered = F.lower(strip(query))
    starts = "^(?:%s)" % "|".join(V.QUESTION_PREFIXES)
    return (
        F.when(_any_word(words(query), V.ACTION_WORDS), F.lit("action_request"))
        .when(lowered.endswith("?") | lowered.rlike(starts), F.lit("question"))
        .otherwise(F.lit("statement"))
    )


def needs_clarification(query: Column) -> Column:
    ws = words(query)
    vague = F.coalesce(F.get(ws, F.lit(0)).isin(V.UNCLEAR_FIRST_WORDS), F.lit(False))
    return (F.size(ws) < 2) | (vague & (F.size(ws) < 5))


def intent_columns(query: Column, n_chunks: Column, top_score: Column) -> dict[str, Column]:
    """The eight decision fields.  ``n_chunks`` is 0 before retrieval."""
    ws = words(query)
    sufficient = F.coalesce(n_chunks, F.lit(0)) > 0
    weak = F.coalesce(top_score < V.WEAK_TOP_SCORE, F.lit(False))
    return {
        "what_is_being_asked": asked_kind(query),
        "clarification_required": needs_clarification(query),
        "retrieval_should_occur": (F.size(ws) > 0) & ~needs_clarification(query),
        "context_sufficient": sufficient,
        "should_invoke_tools": F.lit(False),
        "should_reason_explicitly": _any_word(ws, V.REASONING_WORDS),
        "should_expose_uncertainty": ~sufficient | weak,
        "should_memory_change": ~F.lower(strip(query)).endswith("?")
        & (asked_kind(query) == "statement"),
    }


def plan_steps() -> Column:
    """Ordered steps from the decision fields of the same row."""
    on = F.col
    steps = F.array_compact(
        F.array(
            F.when(on("retrieval_should_occur") & ~on("context_sufficient"), F.lit("retrieve")),
            F.when(on("should_invoke_tools"), F.lit("invoke_tools")),
            F.when(on("should_reason_explicitly"), F.lit("reason")),
            F.lit("generate"),
            F.lit("validate"),
            F.when(on("should_expose_uncertainty"), F.lit("expose_uncertainty")),
            F.when(on("should_memory_change"), F.lit("update_memory")),
        )
    )
    return F.when(on("clarification_required"), F.array(F.lit("clarify"))).otherwise(steps)


def state_path(clarify: Column, failed: Column | None = None) -> Column:
    """States a turn goes through; one whose generation failed stops there."""
    def path(names: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    full = path(V.FULL_STATE_PATH)
    if failed is not None:
        full = F.when(failed, path(V.FULL_STATE_PATH[: V.FULL_STATE_PATH.index("generate") + 1])).otherwise(full)
    return F.when(clarify, path(V.CLARIFY_STATE_PATH)).otherwise(full)
