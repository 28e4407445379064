"""Context sections per query and packing under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import text as T
from .assembly import joined, text_digest
from .graph import retrieved_concepts

SHORTEST_TURN_LINE = 2  # ": " between an empty role and an empty content
POLICY_TEXT = "\n".join(V.SYSTEM_POLICIES)


def chunk_line() -> Column:
    label = T.source_label(F.col("document_title"), F.col("document_id"))
    return F.concat(F.lit("["), label, F.lit("] "), "chunk_text")


def turn_line() -> Column:
    role = F.coalesce("role", F.lit("user"))
    return F.concat(role, F.lit(": "), F.coalesce("content", F.lit("")))


def project_text() -> Column:
    return F.concat(F.lit("Project: "), "name", F.lit("\n"), F.coalesce("description", F.lit("")))


def evidence_text(retrieved: DataFrame) -> DataFrame:
    """Evidence block per query: at most top_k chunks plus web rows each."""
    lines = retrieved.select("query_id", "rank", chunk_line().alias("line"))
    return lines.groupBy("query_id").agg(joined(["rank"], "line", "\n\n").alias("content"))


def history_digest(history: DataFrame, limit: int) -> DataFrame:
    """history(session_id, turn, role, content) to its length and first characters."""
    lines = history.select("session_id", "turn", turn_line().alias("line"))
    return text_digest(lines, ["session_id"], ["turn"], "line", "\n", limit, SHORTEST_TURN_LINE)


def concept_graph_digest(retrieved: DataFrame, edge_digest: DataFrame, limit: int) -> DataFrame:
    """Per query, the edge texts of its concepts in id order: length and prefix.  A
    concept's prefix is either its whole text or already ``limit`` long, so cutting the
    joined prefixes at ``limit`` is exact."""
    rows = retrieved_concepts(retrieved).join(edge_digest, "concept_id")
    return rows.groupBy("query_id").agg(
        (F.sum("n_chars") + F.count("*") - 1).alias("n_chars"),
        F.substring(joined(["concept_id"], "prefix", "\n"), 1, limit).alias("prefix"),
    )


def context_sections(
    queries: DataFrame,
    retrieved: DataFrame,
    history: DataFrame | None = None,
    edge_digest: DataFrame | None = None,
    projects: DataFrame | None = None,
    max_tokens: int = V.CONTEXT_TOKENS,
) -> DataFrame:
    """(query_id, position, priority, name, n_chars, content): the non-empty sections.

    queries(query_id, query, session_id, project_id).  ``content`` of long sections holds
    the first max_tokens·4 characters, all that packing can use; n_chars is the full
    length.  History is summarised once per session, edges once per concept.
    """
    limit = max_tokens * V.CHARS_PER_TOKEN
    base = queries.select(
        F.col("query_id").cast("string").alias("query_id"), "query", "session_id", "project_id"
    )

    def section(rows: DataFrame, position: int, priority: int, name: str, n_chars: Column, content: Column) -> DataFrame:
        return rows.select(
            "query_id",
            F.lit(position).alias("position"),
            F.lit(priority).alias("priority"),
            F.lit(name).alias("name"),
            n_chars.cast("long").alias("n_chars"),
            content.alias("content"),
        )

    message = T.strip(F.col("query"))
    policies = section(base, 0, 0, "system_policies", F.lit(len(POLICY_TEXT)), F.lit(POLICY_TEXT))
    current = section(base, 1, 0, "current_message", F.length(message), message)
    knowledge = section(
        evidence_text(retrieved), 2, 1, "retrieved_knowledge", F.length("content"), F.substring("content", 1, limit)
    )
    out = policies.unionByName(current).unionByName(knowledge)
    if history is not None:
        told = history.join(base.select("session_id").distinct(), "session_id", "left_semi")
        turns = base.join(history_digest(told, limit), "session_id")
        out = out.unionByName(section(turns, 3, 2, "dialogue_history", F.col("n_chars"), F.col("prefix")))
    if edge_digest is not None:
        near = concept_graph_digest(retrieved, edge_digest, limit)
        out = out.unionByName(section(near, 4, 3, "concept_graph", F.col("n_chars"), F.col("prefix")))
    if projects is not None:
        owned = base.join(projects.select(F.col("id").alias("project_id"), "name", "description"), "project_id")
        text = project_text()
        out = out.unionByName(section(owned, 5, 4, "project_state", F.length(text), F.substring(text, 1, limit)))
    return out.where("n_chars > 0")


def pack_sections(sections: DataFrame, max_tokens: int = V.CONTEXT_TOKENS) -> DataFrame:
    """Keep what fits: priority 0 always, then in order until the first section that
    does not fit, which is cut when more than MIN_CUT_TOKENS remain.

    With a running token sum the greedy rule is local to a row: a section fits while the
    sum stays within the budget, and is the first not to fit when the sum before it did.
    """
    order = Window.partitionBy("query_id").orderBy("priority", "position")
    summed = sections.withColumn("estimated_tokens", T.estimate_tokens(F.col("n_chars"))).withColumn(
        "_upto", F.sum("estimated_tokens").over(order)
    )
    room = F.lit(max_tokens) - (F.col("_upto") - F.col("estimated_tokens"))
    fits = (F.col("priority") == 0) | (F.col("_upto") <= max_tokens)
    cut = ~fits & (room > V.MIN_CUT_TOKENS)
    return (
        summed.withColumns({"truncated": cut, "_room": room})
        .where(fits | F.col("truncated"))
        .withColumns(
            {
                "content": F.when(
                    F.col("truncated"), F.substr("content", F.lit(1), F.col("_room").cast("int") * V.CHARS_PER_TOKEN)
                ).otherwise(F.col("content")),
                "estimated_tokens": F.when(F.col("truncated"), F.col("_room")).otherwise(F.col("estimated_tokens")),
            }
        )
        .drop("_upto", "_room", "n_chars")
    )


def context_totals(packed: DataFrame, max_tokens: int = V.CONTEXT_TOKENS) -> DataFrame:
    return packed.groupBy("query_id").agg(
        F.sum("estimated_tokens").alias("total_tokens"),
        F.lit(max_tokens).cast("long").alias("max_tokens"),
    )


def rendered_context(packed: DataFrame) -> DataFrame:
    lines = packed.withColumn("line", F.concat(F.lit("### "), "name", F.lit("\n"), "content"))
    return lines.groupBy("query_id").agg(joined(["priority", "position"], "line", "\n\n").alias("rendered_text"))
