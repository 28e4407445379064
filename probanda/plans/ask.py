"""Queries to validated turns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import intent as I
from ..operators import compare, context, graph, prompts, reason, retrieve, sessions, validate
from ..operators.admit import admit
from ..operators.ledger import Ledger, record_turns
from ..sources.files import write_audit, write_table
from ..wording import DEFAULT_WORDING, Wording


@dataclass
class Knowledge:
    """The stored tables questions are asked of.  ``documents`` is needed only for
    chunks stored without their titles."""

    chunks: DataFrame
    concepts: DataFrame
    edges: DataFrame
    projects: DataFrame | None = None
    documents: DataFrame | None = None


@dataclass
class Evidence:
    """Evidence for every query that needs no clarification; later stages are planned
    when first asked for.

    queries(query_id, query, embedding, session_id, project_id, use_web[, document_id,
    top_k, min_score]).
    """

    all_queries: DataFrame
    knowledge: Knowledge
    history: DataFrame | None = None
    web_results: DataFrame | None = None
    max_tokens: int = V.CONTEXT_TOKENS

    def __post_init__(self) -> None:
        """Only admitted queries are answered; the others are in ``quarantined``."""
        self.all_queries, self.quarantined = admit(self.all_queries)

    @cached_property
    def queries(self) -> DataFrame:
        return self.all_queries.where(~I.needs_clarification(F.col("query")))

    @cached_property
    def retrieved(self) -> DataFrame:
        """Local then web rows; kept, because several branches read it."""
        local = retrieve.retrieve(self.queries, self.knowledge.chunks, self.knowledge.documents)
        web = retrieve.web_evidence(self.queries, self.web_results)
        return retrieve.append_web(local, web).persist()

    @cached_property
    def edge_digest(self) -> DataFrame:
        """Edges of the retrieved concepts only, one row per concept; kept likewise."""
        near = graph.retrieved_concepts(self.retrieved).select("concept_id").distinct()
        limit = self.max_tokens * V.CHARS_PER_TOKEN
        return graph.concept_edge_digest(self.knowledge.edges, limit, near).persist()

    @cached_property
    def packed(self) -> DataFrame:
        sections = context.context_sections(
            self.queries, self.retrieved, self.history, self.edge_digest, self.knowledge.projects, self.max_tokens
        )
        return context.pack_sections(sections, self.max_tokens)

    @cached_property
    def reasons(self) -> DataFrame:
        budgets = context.context_totals(self.packed, self.max_tokens)
        rows = reason.reasoning(self.queries, self.retrieved, self.knowledge.concepts, self.edge_digest, budgets)
        return rows.persist()

    @cached_property
    def intents(self) -> DataFrame:
        return reason.intents(self.all_queries, reason.evidence_summary(self.retrieved))

    def release(self) -> None:
        """Drop what was kept."""
        for name in ("reasons", "edge_digest", "retrieved"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()


def prompts_for(
    evidence: Evidence, history: DataFrame | None = None, wording: Wording = DEFAULT_WORDING
) -> DataFrame:
    return prompts.build_prompts(
        evidence.reasons, evidence.retrieved, evidence.queries.select("query_id", "session_id"), history, wording
    )


def respond(
    evidence: Evidence,
    load: Callable[[], Callable[[list[str]], list[str]]],
    store: str,
    history: DataFrame | None = None,
    wording: Wording = DEFAULT_WORDING,
) -> tuple[DataFrame, DataFrame]:
    """(responses, audit): responses(query_id, response_text, generate_error) from a user
    function, and an event for each retrieved text whose injections the prompt leaves out.

    Both are written below ``store``, replacing what an earlier try left, and read back, so
    no later table calls the function again.
    """
    spark = evidence.all_queries.sparkSession
    made = prompts.generate(prompts_for(evidence, history, wording), load).drop("prompt")
    write_table(made, f"{store}/responses", "overwrite")
    found = prompts.injection_audit(evidence.retrieved, "chunk_text", "retrieved_document", F.current_timestamp())
    write_audit(found, f"{store}/audit", "overwrite")
    return (
        spark.read.schema(made.schema).parquet(f"{store}/responses"),
        spark.read.schema(found.schema).json(f"{store}/audit"),
    )


def settle(queries: DataFrame, evidence: Evidence, responses: DataFrame) -> tuple[DataFrame, Ledger]:
    """Check responses and record the turns: (verdicts, ledger).

    Every table made here reads ``responses``: those of ``respond`` are stored.
    """
    checked = validate.verdicts(responses.where("response_text is not null"), evidence.reasons)
    ledger = record_turns(
        queries,
        evidence.intents,
        evidence.reasons,
        validate.delivered_chat(checked),
        sessions.answer_sources(evidence.retrieved),
        responses.where("response_text is null"),
    )
    return checked, ledger


def summaries(evidence: Evidence) -> DataFrame:
    divergences = compare.divergence_counts(evidence.queries, compare.compare_sources(evidence.retrieved))
    return reason.turn_summaries(evidence.queries, evidence.reasons, divergences)
