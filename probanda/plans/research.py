"""Questions to checked syntheses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import compare, memory, prompts, reason, retrieve, validate
from ..operators.admit import admit
from ..wording import DEFAULT_WORDING, Wording
from .ask import Knowledge


@dataclass
class Research:
    questions: DataFrame
    parts: DataFrame
    retrieved: DataFrame
    comparisons: DataFrame
    references: DataFrame
    confidence: DataFrame
    prompts: DataFrame


def investigate(
    questions: DataFrame,
    knowledge: Knowledge,
    web_results: DataFrame | None = None,
    embed_parts: Callable[[DataFrame], DataFrame] | None = None,
    wording: Wording = DEFAULT_WORDING,
) -> Research:
    """Split, search each part, merge, compare and write the synthesis prompts.

    ``embed_parts`` turns the parts table into one with a vector per part; without it a
    part uses its question's vector.  ``web_results`` is keyed by part id.
    """
    questions = admit(questions)[0]
    parts = retrieve.explode_sub_questions(questions)
    if embed_parts is not None:
        parts = embed_parts(parts)
    found = retrieve.retrieve(parts, knowledge.chunks, knowledge.documents)
    local = retrieve.merge_sub_results(found)
    web = retrieve.merge_sub_web(retrieve.web_evidence(parts, web_results))
    retrieved = retrieve.append_web(local, web).persist()
    comparisons = compare.compare_sources(retrieved)
    references = compare.references(retrieved)
    confidence = reason.research_confidence(questions, retrieved)
    texts = prompts.research_prompts(confidence, retrieved, wording)
    return Research(questions, parts, retrieved, comparisons, references, confidence, texts)


def conclude(research: Research, responses: DataFrame) -> DataFrame:
    """(query_id, delivered, synthesized_answer, violations) for given responses."""
    checked = validate.verdicts(responses.where("response_text is not null"), research.confidence)
    return validate.delivered_research(checked, research.prompts)


def research_memory(research: Research, concluded: DataFrame, at: str = "asked_at") -> DataFrame:
    """Interactions for ``memory.remember``."""
    answers = research.questions.select("query_id", "query", F.col(at).alias("created_at")).join(concluded, "query_id")
    return memory.research_interactions(answers, research.parts, research.references)
