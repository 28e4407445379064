"""Sessions, turns and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..schemas import SOURCE_LIST


def conversation_history(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question with its answers, or without one."""
    replies = answers.select(
        F.col("id").alias("answer_id"), "question_id", F.col("text").alias("answer_text"), "confidence", "sources"
    )
    asked = questions.select(
        F.col("id").alias("question_id"), "session_id", F.col("text").alias("question_text"),
        F.col("created_at").alias("asked_at"),
    )
    return asked.join(replies, "question_id", "left")


def in_session_order(history: DataFrame) -> DataFrame:
    """The rows of a session lie together, in the order they were asked."""
    return history.repartition("session_id").sortWithinPartitions("session_id", "asked_at", "question_id")


def typed_sources(answers: DataFrame) -> DataFrame:
    """answers with ``sources`` as an array, whether it was stored so or as JSON text."""
    if dict(answers.dtypes)["sources"] == "string":
        return answers.withColumn("sources", F.from_json("sources", SOURCE_LIST))
    return answers


def exploded_sources(answers: DataFrame) -> DataFrame:
    """One row per source of an answer; an answer without sources keeps one empty row."""
    return typed_sources(answers).select(
        F.col("id").alias("answer_id"), F.posexplode_outer("sources").alias("position", "source")
    ).select("answer_id", "position", "source.*")


def session_summaries(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages, answered messages, distinct sources and concepts of every session.

    One pass: each joined row is taken apart into what it counts for, equal items are
    counted per session before sessions meet, so a session with a large share of all
    turns is reduced by many tasks.
    """
    rows = conversation_history(questions, typed_sources(answers))

    def item(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def source(s: Column) -> Column:
        named = F.coalesce(F.nullif(s["document_id"], F.lit("")), F.nullif(s["url"], F.lit("")), F.nullif(s["title"], F.lit("")))
        return item("source", named)

    used = F.coalesce("sources", F.array().cast(SOURCE_LIST))
    none = F.lit(None).cast("string")
    items = F.concat(
        F.array(item("message", none), item("verified", F.when(F.col("answer_id").isNotNull(), F.lit("")))),
        F.transform(used, source),
        F.transform(used, lambda s: item("concept", F.nullif(s["concept_id"], F.lit("")))),
    )
    counted = (
        rows.select("session_id", F.explode(items).alias("i"))
        .where("i.kind = 'message' or i.key is not null")
        .groupBy("session_id", "i.kind", "i.key")
        .agg(F.count("*").alias("n"))
    )

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"{kind}_count")

    def distinct(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(f"{kind}_count")

    return counted.groupBy("session_id").agg(total("message"), total("verified"), distinct("source"), distinct("concept"))


def previous_turns(turns: DataFrame, span: int = 4096) -> DataFrame:
    """turns(session_id, turn, role, content) with the turn before.

    ``turn`` is a whole number.  Ordering happens inside spans of turn numbers, so no
    task sorts a whole session; the last turn of each non-empty span is carried over to
    the next one, spans being far fewer than turns.
    """
    cut = turns.withColumn("_span", F.floor(F.col("turn") / span))
    last = cut.groupBy("session_id", "_span").agg(
        F.max_by(F.struct(F.col("role").alias("r"), F.col("content").alias("c")), "turn").alias("_last")
    )
    earlier = Window.partitionBy("session_id").orderBy("_span")
    carried = last.select("session_id", "_span", F.lag("_last").over(earlier).alias("_carried"))
    inside = Window.partitionBy("session_id", "_span").orderBy("turn")
    before = F.lag(F.struct(F.col("role").alias("r"), F.col("content").alias("c"))).over(inside)
    rows = cut.withColumn("_before", before).join(carried, ["session_id", "_span"])
    previous = F.coalesce("_before", "_carried")
    return rows.select(
        "session_id", "turn", "role", "content",
        previous["r"].alias("previous_role"), previous["c"].alias("previous_content"),
    )


def resolve_sessions(requests: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(request_id, session_id, …): known sessions stay, unknown or missing ones
    become new sessions.  Returns (requests with session_id and was_created, events)."""
    known = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("_known"))
    fresh = T.stable_id(F.lit("session"), F.col("request_id"))
    out = requests.join(known, "session_id", "left").withColumns(
        {"was_created": F.col("_known").isNull()}
    ).withColumn("session_id", F.when(F.col("was_created"), fresh).otherwise(F.col("session_id"))).drop("_known")
    events = out.where("was_created").select(
        F.lit("ConversationStarted").alias("name"), F.to_json(F.struct("session_id")).alias("payload")
    )
    return out, events


def answer_sources(retrieved: DataFrame) -> DataFrame:
    """Per query the first evidence of each document or URL, in rank order."""
    key: Column = F.coalesce(F.nullif("document_id", F.lit("")), F.nullif("url", F.lit("")))
    source = F.struct("document_id", F.col("document_title").alias("title"), "source_type", "url", "concept_id")
    first = (
        retrieved.withColumn("_key", key)
        .where("_key is not null")
        .groupBy("query_id", "_key")
        .agg(F.min("rank").alias("rank"), F.min_by(source, "rank").alias("source"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source")))
    return first.groupBy("query_id").agg(F.transform(ordered, lambda x: x["source"]).alias("sources"))
