"""What a batch of turns leaves behind: questions, answers, memory and events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import intent as I
from ..functions import text as T
from ..schemas import SOURCE_LIST


@dataclass
class Ledger:
    turns: DataFrame
    questions: DataFrame
    answers: DataFrame
    interactions: DataFrame
    events: DataFrame


def record_turns(
    queries: DataFrame,
    intents: DataFrame,
    reasons: DataFrame,
    chat: DataFrame,
    sources: DataFrame,
    failed: DataFrame | None = None,
) -> Ledger:
    """queries(query_id, query, session_id, project_id, asked_at), ``intents`` as read
    after retrieval, ``chat`` as from ``validate.delivered_chat``, ``sources`` as from
    ``sessions.answer_sources``.

    A query that needs clarification is answered with the fixed text and skips
    retrieval, reasoning and checks.  A query in ``failed(query_id)`` got no response from
    the generator: its question is kept and its reasoning told, but there is no answer and
    no memory; the reply is a fixed text.
    """
    if failed is None:
        failed = queries.select("query_id").where("false")
    rows = (
        queries.select("query_id", "query", "session_id", "project_id", "asked_at")
        .join(intents.select("query_id", "clarification_required", "should_memory_change"), "query_id")
        .join(reasons.select("query_id", "overall"), "query_id", "left")
        .join(chat.select("query_id", "delivered_text"), "query_id", "left")
        .join(sources, "query_id", "left")
        .join(failed.select("query_id").distinct().withColumn("failed", F.lit(True)), "query_id", "left")
        .withColumn("failed", F.coalesce(F.col("failed") & ~F.col("clarification_required"), F.lit(False)))
    )
    clarify = F.col("clarification_required")
    question_id = T.stable_id(F.lit("question"), F.col("session_id"), F.col("query_id"))
    turns = rows.select(
        "query_id",
        "query",
        "session_id",
        "project_id",
        "asked_at",
        "should_memory_change",
        clarify.alias("clarified"),
        question_id.alias("question_id"),
        "failed",
        F.when(clarify, V.CLARIFICATION_TEXT).when(~F.col("failed"), F.col("delivered_text")).alias("answer"),
        F.when(~clarify, F.col("overall")).alias("confidence"),
        F.when(~clarify, F.col("sources")).alias("sources"),
        I.state_path(clarify, F.col("failed")).alias("state_path"),
    ).withColumns({
        "delivered": F.col("answer").isNotNull(),
        "reply": F.when(F.col("failed"), V.INTERNAL_ERROR_TEXT).otherwise(F.col("answer")),
    })
    questions = turns.select(
        F.col("question_id").alias("id"),
        "session_id",
        F.lit(None).cast("string").alias("conversation_id"),
        F.col("query").alias("text"),
        F.col("asked_at").alias("created_at"),
    )
    answers = turns.where("answer is not null").select(
        T.stable_id(F.lit("answer"), F.col("question_id")).alias("id"),
        "question_id",
        F.col("answer").alias("text"),
        "confidence",
        F.coalesce("sources", F.array().cast(SOURCE_LIST)).alias("sources"),
        F.col("asked_at").alias("created_at"),
    )
    # An empty answer that passed its checks is stored, but remembered as not delivered.
    told = F.coalesce(F.nullif("answer", F.lit("")), F.lit(V.NOT_DELIVERED_TEXT))
    dialogue = turns.where("not failed").select(
        F.concat_ws("|", F.lit("dialogue"), "question_id").alias("interaction_id"),
        F.concat(F.lit("Q: "), "query", F.lit("\nA: "), told).alias("content"),
        F.lit("dialogue").alias("tier"),
        F.col("session_id").alias("scope_id"),
        F.lit("{}").alias("metadata"),
        F.col("asked_at").alias("created_at"),
    )
    statements = turns.where("answer is not null and should_memory_change and not clarified").select(
        F.concat_ws("|", F.lit("statement"), "question_id").alias("interaction_id"),
        F.col("query").alias("content"),
        F.lit("research").alias("tier"),
        F.col("project_id").alias("scope_id"),
        F.lit("{}").alias("metadata"),
        F.col("asked_at").alias("created_at"),
    )
    events = turns.where("not clarified").select(
        F.lit("ReasoningCompleted").alias("name"),
        F.to_json(F.struct("session_id", "confidence")).alias("payload"),
    )
    return Ledger(turns, questions, answers, dialogue.unionByName(statements), events)
