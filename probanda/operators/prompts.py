"""Prompt texts per query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..session import ship_package
from .calls import BATCH, answered
from ..wording import DEFAULT_WORDING, Wording
from .assembly import joined, ordered_text
from .context import POLICY_TEXT, turn_line


def _filled(pattern: str, value: Column) -> Column:
    """``value`` in place of the one %s of a wording."""
    before, after = pattern.split("%s")
    return F.concat(F.lit(before), value, F.lit(after))


def evidence_line(text: Column) -> Column:
    label = T.source_label(F.col("document_title"), F.col("document_id"))
    web = F.concat(
        F.lit("WEB (external, unverified) ["), label, F.lit("]: "), text,
        F.lit(" (source: "), F.coalesce("url", F.lit("")), F.lit(")"),
    )
    local = F.concat(F.lit("LOCAL (knowledge base) ["), label, F.lit("]: "), text)
    return F.when(F.col("source_type") == "web", web).otherwise(local)


def evidence_block(retrieved: DataFrame, redact: bool) -> DataFrame:
    text = T.redact_injection(F.col("chunk_text")) if redact else F.col("chunk_text")
    lines = retrieved.select("query_id", "rank", evidence_line(text).alias("line"))
    return lines.groupBy("query_id").agg(joined(["rank"], "line", "\n\n").alias("evidence_block"))


def injection_audit(rows: DataFrame, text: str, source: str, at: Column) -> DataFrame:
    """One audit event per text with at least one injection pattern."""
    patterns = T.detect_injection(F.col(text))
    details = F.to_json(F.struct(F.lit(source).alias("source"), F.col("patterns")))
    return (
        rows.withColumn("patterns", patterns)
        .where(F.size("patterns") > 0)
        .select(at.alias("timestamp"), F.lit("prompt_injection_detected").alias("event_type"), details.alias("details"))
    )


def policy_layer(wording: Wording = DEFAULT_WORDING) -> Column:
    """Two fixed lines plus those the row's assumptions, constraints, confidence and web
    evidence call for."""
    lines = F.array_compact(
        F.array(
            F.lit(wording.ground),
            F.lit(wording.attribute),
            F.when(F.size("assumptions") > 0, _filled(wording.assumptions, F.array_join("assumptions", ", "))),
            F.when(F.size("constraints") > 0, _filled(wording.constraints, F.array_join("constraints", ", "))),
            F.when(F.col("overall").isNotNull(), _filled(wording.confidence, T.two_decimals(F.col("overall")))),
            F.when(F.col("has_web"), F.lit(wording.web)),
        )
    )
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")


def history_text(history: DataFrame) -> DataFrame:
    """Whole history per session, assembled span by span."""
    lines = history.select("session_id", "turn", turn_line().alias("line"))
    return ordered_text(lines, ["session_id"], "turn", "line", "\n", "history")


def build_prompts(
    reasons: DataFrame,
    retrieved: DataFrame,
    sessions: DataFrame | None = None,
    history: DataFrame | None = None,
    wording: Wording = DEFAULT_WORDING,
) -> DataFrame:
    """(query_id, prompt): seven layers in fixed order, empty ones left out.

    ``reasons`` as from ``reason.reasoning``; ``sessions(query_id, session_id)`` maps a
    query to its history.
    """
    rows = reasons.join(evidence_block(retrieved, redact=True), "query_id", "left")
    if sessions is not None and history is not None:
        asked = history.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
        told = sessions.select("query_id", "session_id").join(history_text(asked), "session_id")
        rows = rows.join(told.select("query_id", "history"), "query_id", "left")
    else:
        rows = rows.withColumn("history", F.lit(None).cast("string"))
    layers = [
        ("system", F.lit(wording.system)),
        ("architecture_policy", F.lit(POLICY_TEXT)),
        ("module_policy", policy_layer(wording)),
        ("task_instructions", F.lit(wording.task)),
        ("retrieved_knowledge", F.coalesce("evidence_block", F.lit(V.PROMPT_EMPTY_TEXT))),
        ("conversation", F.col("history")),
        ("user_message", T.strip(F.col("query"))),
    ]
    shown = [
        F.when(content.isNotNull() & (content != ""), F.concat(F.lit(f"### {name.upper()}\n"), content))
        for name, content in layers
    ]
    return rows.select("query_id", F.concat_ws("\n\n", *shown).alias("prompt"))


def research_prompts(
    confidence: DataFrame, retrieved: DataFrame, wording: Wording = DEFAULT_WORDING
) -> DataFrame:
    """(query_id, prompt, answer): a synthesis prompt, or for a question without any
    chunk no prompt and the fixed answer."""
    rows = confidence.join(evidence_block(retrieved, redact=False), "query_id", "left")
    shown = T.two_decimals(F.col("overall"))
    parts = F.concat_ws(
        "\n\n",
        _filled(wording.research_question, F.col("query")),
        F.col("evidence_block"),
        F.lit(wording.research_rules),
        _filled(wording.research_confidence, shown),
        F.when(F.col("overall") < V.LOW_CONFIDENCE, F.lit(wording.research_hedge)),
    )
    found = F.col("n_chunks") > 0
    return rows.select(
        "query_id",
        F.when(found, parts).alias("prompt"),
        F.when(~found, F.lit(V.RESEARCH_EMPTY_TEXT)).alias("answer"),
    )


def summary_prompt(text: Column, max_words: int = V.SUMMARY_WORDS, wording: Wording = DEFAULT_WORDING) -> Column:
    return _filled(wording.summarize.replace("%d", str(max_words)), text)


def generate(
    prompts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", batch: int = BATCH
) -> DataFrame:
    """Adds response_text and generate_error from a user function loaded once per task and
    called with ``batch`` prompts.  Null prompts stay null; a failing prompt gets an error,
    not a failed job, and is found by halving."""

    @F.pandas_udf("response_text string, generate_error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        writer = load()
        for texts in batches:
            values = texts.tolist()
            waiting = answered(writer, [t for t in values if t is not None], batch)
            rows = [(None, None) if t is None else next(waiting) for t in values]
            yield pd.DataFrame(rows, columns=["response_text", "generate_error"])

    ship_package(prompts.sparkSession)
    made = prompts.withColumn("_made", run(F.col(prompt)))
    return made.select(*prompts.columns, "_made.response_text", "_made.generate_error")
