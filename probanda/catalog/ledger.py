"""Turn ledger, sessions and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..operators import memory, sessions
from ..plans import ask, research
from . import sql as S
from .inputs import Inputs
from .registry import query
from .retrieval import gathered, investigated, with_research
from .text import ANSWER_SOURCES
from .validation import template_responses

# The verdicts of the queries that needed no clarification, the fixed answer for the rest.
_MEMORABLE = (
    "(NOT ends_with(low, '?') AND NOT list_has_any(ws, [" + ", ".join(S.quoted(w) for w in V.ACTION_WORDS) + "]) "
    "AND NOT regexp_matches(low, '^(?:" + "|".join(V.QUESTION_PREFIXES) + ")'))"
)
TURNS = {
    "turns": "SELECT a.query_id, a.query, a.project_id, v.query_id IS NULL AS clarified, sha256('question|' || a.query_id || '|' || a.query_id) AS question_id, "
    f"CASE WHEN v.query_id IS NULL THEN {S.quoted(V.CLARIFICATION_TEXT)} WHEN v.delivered THEN v.response_text END AS answer, v.overall AS confidence, {_MEMORABLE} AS memorable "
    "FROM asked a LEFT JOIN verdicts v USING (query_id)",
}


def _turns(select: str, **more: str) -> str:
    return S.with_("verdicts asked", select, {**TURNS, **more})


def _ledger(spark: SparkSession, sf: str):
    i = Inputs(spark, sf)
    evidence = gathered(i)
    return ask.settle(i.asked, evidence, template_responses(evidence))[1]


@query(
    "turn_questions_and_answers",
    "M1",
    _turns(
        "SELECT question_id, sha256(query) AS question_hash, CASE WHEN answer IS NOT NULL THEN sha256('answer|' || question_id) END AS answer_id, answer, "
        "CASE WHEN answer IS NOT NULL THEN confidence END AS confidence, CASE WHEN answer IS NULL THEN -1 WHEN clarified THEN 0 ELSE coalesce(n_sources, 0) END AS n_sources FROM turns LEFT JOIN "
        "(SELECT query_id, count(DISTINCT coalesce(nullif(document_id, ''), nullif(url, ''))) AS n_sources FROM retrieved GROUP BY 1) USING (query_id)"
    ),
)
def turn_questions_and_answers(spark: SparkSession, sf: str) -> DataFrame:
    made = _ledger(spark, sf)
    questions = made.questions.select(F.col("id").alias("question_id"), F.sha2("text", 256).alias("question_hash"))
    answers = made.answers.select(
        "question_id", F.col("id").alias("answer_id"), F.col("text").alias("answer"), "confidence", F.size("sources").cast("long").alias("n_sources")
    )
    return questions.join(answers, "question_id", "left").na.fill(-1, ["n_sources"])


@query(
    "turn_memory",
    "M1",
    _turns(
        f"SELECT 'dialogue' AS tier, query_id AS scope_id, sha256('Q: ' || query || chr(10) || 'A: ' || coalesce(nullif(answer, ''), {S.quoted(V.NOT_DELIVERED_TEXT)})) AS content_hash FROM turns "
        f"UNION ALL SELECT 'research', project_id, sha256({S.strip('query')}) FROM turns WHERE answer IS NOT NULL AND memorable AND NOT clarified"
    ),
)
def turn_memory(spark: SparkSession, sf: str) -> DataFrame:
    records, _, _ = memory.remember(_ledger(spark, sf).interactions)
    return records.select("tier", "scope_id", F.sha2("content", 256).alias("content_hash"))


@query(
    "failed_turns",
    "M1",
    _turns(
        "SELECT query_id, failed, answer IS NOT NULL AND NOT failed AS delivered, "
        f"CASE WHEN failed THEN {S.quoted(V.INTERNAL_ERROR_TEXT)} ELSE answer END AS reply, "
        "CASE WHEN failed OR answer IS NULL THEN 0 ELSE 1 END::BIGINT AS answers, CASE WHEN failed THEN 0 ELSE 1 END::BIGINT AS dialogues, confidence "
        "FROM (SELECT *, NOT clarified AND CAST(query_id AS INT) % 3 = 1 AS failed FROM turns)"
    ),
)
def failed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The generator fails for some queries."""
    i = Inputs(spark, sf)
    evidence = gathered(i)
    given = template_responses(evidence)
    failing = given.withColumn("response_text", F.when(F.col("query_id").cast("int") % 3 != 1, F.col("response_text")))
    made = ask.settle(i.asked, evidence, failing)[1]
    answers = made.answers.groupBy("question_id").agg(F.count("*").alias("answers"))
    dialogue = made.interactions.where("tier = 'dialogue'").select(F.substring_index("interaction_id", "|", -1).alias("question_id"))
    dialogue = dialogue.groupBy("question_id").agg(F.count("*").alias("dialogues"))
    rows = made.turns.join(answers, "question_id", "left").join(dialogue, "question_id", "left").na.fill(0, ["answers", "dialogues"])
    return rows.select("query_id", "failed", "delivered", "reply", "answers", "dialogues", "confidence")


@query(
    "turn_events",
    "M1",
    _turns("SELECT 'ReasoningCompleted' AS name, query_id AS session_id, confidence FROM turns WHERE NOT clarified"),
)
def turn_events(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.from_json("payload", "session_id string, confidence double")
    return _ledger(spark, sf).events.select("name", payload["session_id"].alias("session_id"), payload["confidence"].alias("confidence"))


@query(
    "turn_summaries",
    "G3 G4",
    S.with_(
        "reasons pairs",
        "SELECT r.query_id, n AS sources_checked, n AS evidence_count, coalesce(d, 0) AS divergent_phrasing_count, agreement AS agreement_score, overall AS confidence, n AS retrieved_chunk_count, "
        "coalesce(n_documents, 0) AS document_count, n_rel AS concept_relationship_count FROM reasons r LEFT JOIN (SELECT query_id, count(*) AS d FROM pairs WHERE overlap < 0.3 GROUP BY 1) USING (query_id)",
    ),
)
def turn_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return ask.summaries(gathered(Inputs(spark, sf)))


@query(
    "session_summaries",
    "G5",
    f"WITH src AS ({ANSWER_SOURCES}), rows AS (SELECT CAST(u.conv_id AS VARCHAR) AS session_id, CASE WHEN a.conv_id IS NOT NULL THEN 'a' || a.conv_id || '.' || a.turn END AS answer_id FROM conversations u "
    "LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user') "
    "SELECT session_id, message_count, verified_count, coalesce(source_count, 0) AS source_count, coalesce(concept_count, 0) AS concept_count FROM "
    "(SELECT session_id, count(*) AS message_count, count(answer_id) AS verified_count FROM rows GROUP BY 1) LEFT JOIN "
    "(SELECT r.session_id, count(DISTINCT coalesce(nullif(s.document_id, ''), nullif(s.url, ''), nullif(s.title, ''))) AS source_count, count(DISTINCT nullif(s.concept_id, '')) AS concept_count "
    "FROM rows r JOIN src USING (answer_id) GROUP BY 1) USING (session_id)",
)
def session_summaries(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    return sessions.session_summaries(i.questions, i.answers)


@query(
    "answer_sources",
    "G6",
    S.with_(
        "retrieved",
        "SELECT query_id, string_agg(key || '/' || title || '/' || source_type || '/' || coalesce(concept_id, ''), ' ' ORDER BY r) AS sources FROM (SELECT query_id, key, min(rank) AS r, arg_min(title, rank) AS title, "
        "arg_min(source_type, rank) AS source_type, arg_min(concept_id, rank) AS concept_id FROM (SELECT *, coalesce(nullif(document_id, ''), nullif(url, '')) AS key FROM retrieved) WHERE key IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    ),
)
def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions.answer_sources(gathered(Inputs(spark, sf)).retrieved)
    shown = F.transform(
        "sources",
        lambda s: F.concat(
            F.coalesce(F.nullif(s["document_id"], F.lit("")), s["url"]), F.lit("/"), s["title"], F.lit("/"),
            s["source_type"], F.lit("/"), F.coalesce(s["concept_id"], F.lit("")),
        ),
    )
    return rows.select("query_id", F.array_join(shown, " ").alias("sources"))


_RESOLVED = (
    "SELECT event_id, sid, sid IS NOT NULL AND sid IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations) AS known FROM "
    "(SELECT event_id, CASE WHEN event_id % 4 > 0 THEN CAST(user_id AS VARCHAR) END AS sid FROM events)"
)


@query(
    "resolve_sessions",
    "M3",
    f"SELECT event_id AS request_id, CASE WHEN known THEN sid ELSE sha256('session|' || event_id) END AS session_id, NOT known AS was_created FROM ({_RESOLVED}) "
    f"UNION ALL SELECT -1, 'ConversationStarted ' || count(*), NULL FROM ({_RESOLVED}) WHERE NOT known",
)
def resolve_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The resolved requests, and one row with the number of sessions announced."""
    i = Inputs(spark, sf)
    requests = i.events.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 4 > 0, F.col("user_id").cast("string")).alias("session_id"),
    )
    known = i.history.select(F.col("session_id").alias("id")).distinct()
    resolved, events = sessions.resolve_sessions(requests, known)
    announced = events.groupBy("name").agg(F.count("*").alias("n")).select(
        F.lit(-1).cast("long").alias("request_id"),
        F.concat_ws(" ", "name", "n").alias("session_id"),
        F.lit(None).cast("boolean").alias("was_created"),
    )
    return resolved.select("request_id", "session_id", "was_created").unionByName(announced)


def _interactions(i: Inputs) -> DataFrame:
    """Every document, and once more under a negative id, some of those without content."""
    n = F.col("doc_id")
    tiers = F.array(*[F.lit(t) for t in [*memory.TIERS, "archive"]])
    given = i.documents_raw.select(
        n.alias("interaction_id"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("content"), F.get(tiers, (n % 9).cast("int")).alias("tier"), "source"
    )
    odd = i.documents_raw.select(
        (-1 - n).alias("interaction_id"), F.when(n % 11 == 0, "").when(n % 11 == 1, "  \n ").when(n % 11 > 2, F.col("text")).alias("content"),
        F.get(tiers, (n % 9).cast("int")).alias("tier"), "source",
    )
    return given.unionByName(odd).select(
        "interaction_id",
        "content",
        "tier",
        F.col("source").alias("scope_id"),
        F.lit(None).cast("string").alias("metadata"),
        F.timestamp_seconds("interaction_id").alias("created_at"),
    )


_TIERS = "[" + ", ".join(f"'{t}'" for t in [*memory.TIERS, "archive"]) + "]"
_MEMORY = (
    f"SELECT doc_id, doc_id % 9 AS nth, source, coalesce({_TIERS}[doc_id % 9 + 1], 'working') AS tier, ' ' || text || chr(10) AS content FROM documents UNION ALL "
    f"SELECT -1 - doc_id, doc_id % 9, source, coalesce({_TIERS}[doc_id % 9 + 1], 'working'), CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN '  ' || chr(10) WHEN 2 THEN NULL ELSE text END FROM documents"
)


@query(
    "remember",
    "M4",
    f"SELECT sha256('memory|' || doc_id) AS id, tier, source AS scope_id, sha256({S.strip('content')}) AS content_hash, NULL::VARCHAR AS reject_reason FROM ({_MEMORY}) WHERE content <> '' AND tier <> 'archive' "
    f"UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN nth < 8 THEN tier END, NULL, NULL, CASE WHEN coalesce(content, '') = '' THEN 'empty_content' ELSE 'unknown_tier' END FROM ({_MEMORY}) WHERE coalesce(content, '') = '' OR tier = 'archive' "
    f"UNION ALL SELECT 'MemoryUpdated', tier, CAST(count(*) AS VARCHAR), NULL, NULL FROM ({_MEMORY}) WHERE content <> '' AND tier <> 'archive' GROUP BY tier",
)
def remember(spark: SparkSession, sf: str) -> DataFrame:
    records, rejected, events = memory.remember(_interactions(Inputs(spark, sf)))
    none = F.lit(None).cast("string")
    kept = records.select("id", "tier", "scope_id", F.sha2("content", 256).alias("content_hash"), none.alias("reject_reason"))
    refused = rejected.select(
        F.col("interaction_id").cast("string").alias("id"), "tier", none.alias("scope_id"), none.alias("content_hash"), "reject_reason"
    )
    told = events.groupBy(F.col("name").alias("id"), F.get_json_object("payload", "$.tier").alias("tier")).agg(
        F.count("*").cast("string").alias("scope_id")
    ).select("id", "tier", "scope_id", none.alias("content_hash"), none.alias("reject_reason"))
    return kept.unionByName(refused).unionByName(told)


_ROUTED = f"SELECT *, tier IN {S.in_list(V.PERSISTENT_TIERS)} AS persistent FROM ({_MEMORY}) WHERE content <> '' AND tier <> 'archive'"


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from ..session import shared_dir

    records, _, _ = memory.remember(_interactions(Inputs(spark, sf)))
    kept, run = shared_dir(spark, "memory"), shared_dir(spark, "run-memory")
    memory.write_memory(records, kept, run)
    return spark.read.parquet(kept), spark.read.parquet(run)


@query("memory_tiers", "M5", f"SELECT persistent, tier, count(*) AS records FROM ({_ROUTED}) GROUP BY 1, 2")
def memory_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Write the records to their two stores and count what each holds."""
    kept, run = _stored(spark, sf)
    both = kept.withColumn("persistent", F.lit(True)).unionByName(run.withColumn("persistent", F.lit(False)))
    return both.groupBy("persistent", "tier").agg(F.count("*").alias("records"))


@query(
    "recall",
    "M6",
    f"SELECT sha256('memory|' || doc_id) AS id, tier, sha256({S.strip('content')}) AS content_hash FROM ({_ROUTED}) WHERE persistent AND doc_id % 2 = 0",
)
def recall(spark: SparkSession, sf: str) -> DataFrame:
    """Ask for every id under its own tier (even ids) or under another one (odd ids)."""
    kept, _ = _stored(spark, sf)
    asked = _interactions(Inputs(spark, sf))
    other = F.when(F.col("interaction_id") % 2 == 0, F.col("tier")).otherwise("session")
    wanted = asked.select(other.alias("tier"), T.stable_id(F.lit("memory"), F.col("interaction_id")).alias("id"))
    return memory.recall(kept, wanted).select("id", "tier", F.sha2("content", 256).alias("content_hash"))


@query(
    "research_memory",
    "M7",
    with_research(
        "SELECT a.query_id, n AS n_sub_questions, coalesce(r, 0) AS n_references, sha256(a.query) AS question_hash FROM asked a JOIN (SELECT query_id, count(*) AS n FROM parts GROUP BY 1) USING (query_id) "
        "LEFT JOIN (SELECT query_id, count(DISTINCT coalesce(document_id, url, chunk_id)) AS r FROM found GROUP BY 1) USING (query_id)"
    ),
)
def research_memory(spark: SparkSession, sf: str) -> DataFrame:
    done = investigated(Inputs(spark, sf))
    written = done.prompts.where("prompt is not null").select("query_id", F.lit("It is unclear.").alias("response_text"))
    records, _, _ = memory.remember(research.research_memory(done, research.conclude(done, written)))
    kept = F.from_json("metadata", "question string, sub_questions array<string>, references array<struct<document_id:string>>")
    questions = done.questions.select("query_id", T.stable_id(F.lit("memory"), F.concat_ws("|", F.lit("research"), "query_id")).alias("id"))
    return records.where("tier = 'research'").join(questions, "id").select(
        "query_id",
        F.size(kept["sub_questions"]).cast("long").alias("n_sub_questions"),
        F.size(kept["references"]).cast("long").alias("n_references"),
        F.sha2(kept["question"], 256).alias("question_hash"),
    )
