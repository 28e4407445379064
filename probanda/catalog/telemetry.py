"""Request limits, traces and metrics over the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..operators import ingest, limits, telemetry
from . import sql as S
from .inputs import Inputs
from .registry import query

# the given events are sparse: a small limit in a wide window makes refusals happen
LIMIT, WINDOW_SECONDS = 2, 21600


@query(
    "sliding_request_counts",
    "H3",
    f"SELECT event_id AS request_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW_SECONDS * 1000000} PRECEDING AND CURRENT ROW) AS in_window FROM events",
)
def sliding_request_counts(spark: SparkSession, sf: str) -> DataFrame:
    return limits.sliding_counts(Inputs(spark, sf).requests, WINDOW_SECONDS).select("request_id", "in_window")


def admission_sql(limit: int, seconds: int) -> str:
    """The rule step by step: request n of each identity, carrying the admitted times."""
    kept = f"list_filter(r.admitted, lambda t: t >= e.at_us - {seconds * 1000000})"
    return (
        "WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events), "
        "r AS (SELECT user_id, n, event_id, [at_us] AS admitted, true AS ok FROM e WHERE n = 1 UNION ALL "
        f"SELECT e.user_id, e.n, e.event_id, CASE WHEN len({kept}) < {limit} THEN list_append({kept}, e.at_us) ELSE {kept} END, len({kept}) < {limit} FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) "
    )


@query(
    "admission_limit",
    "H4",
    admission_sql(LIMIT, WINDOW_SECONDS) + "SELECT event_id AS request_id, ok AS admitted FROM r",
)
def admission_limit(spark: SparkSession, sf: str) -> DataFrame:
    return limits.admit(Inputs(spark, sf).requests, LIMIT, WINDOW_SECONDS).select("request_id", "admitted")


@query(
    "rate_limit_audit",
    "H4 A8",
    admission_sql(1, 3600) + "SELECT 'rate_limit_exceeded' AS event_type, CAST(user_id AS VARCHAR) AS identity, count(*) AS refused FROM r WHERE NOT ok GROUP BY 2",
)
def rate_limit_audit(spark: SparkSession, sf: str) -> DataFrame:
    audit = limits.limit_audit(limits.admit(Inputs(spark, sf).requests, 1, 3600))
    return audit.groupBy("event_type", F.get_json_object("details", "$.identity").alias("identity")).agg(
        F.count("*").alias("refused")
    )


# --- traces --------------------------------------------------------------------------
_STAGES = "[" + ", ".join(f"'{s}'" for s in [*V.TRACE_STAGES, "llm_generate"]) + "]"
TRACES = (
    f"SELECT 't' || event_id // 20 AS trace_id, event_id AS seq, {_STAGES}[user_id % 7 + 1] AS stage, CASE event_type WHEN 'click' THEN 'stage_start' WHEN 'view' THEN 'stage_end' "
    "WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'metric' ELSE 'stage_start' END AS event_type, ts, CASE WHEN event_id % 2 = 0 THEN value END AS duration_ms FROM events"
)


@query(
    "traces_of_failed_requests",
    "N1",
    f"SELECT trace_id, seq, stage, event_type, epoch_us(ts) AS at_us FROM ({TRACES}) WHERE trace_id IN (SELECT trace_id FROM ({TRACES}) WHERE event_type = 'failure' AND stage = 'reason')",
)
def traces_of_failed_requests(spark: SparkSession, sf: str) -> DataFrame:
    events = Inputs(spark, sf).trace_events
    failed = events.where("event_type = 'failure' and stage = 'reason'")
    rows = telemetry.trace(events, failed)
    return rows.select("trace_id", "seq", "stage", "event_type", F.unix_micros("timestamp").alias("at_us"))


_CLOSED = (
    "SELECT * EXCLUDE (duration_ms), coalesce(duration_ms, (epoch_us(ts) - epoch_us(started)) / 1000) AS d FROM (SELECT *, max(CASE WHEN event_type = 'stage_start' THEN ts END) OVER "
    f"(PARTITION BY trace_id, stage ORDER BY ts, seq) AS started FROM ({TRACES}) WHERE event_type IN ('stage_start', 'stage_end', 'failure')) WHERE event_type <> 'stage_start'"
)


def _quantile(q: float) -> str:
    return f"min(d) FILTER (rn >= ceil({q} * total))"


@query(
    "stage_latency",
    "N2",
    f"SELECT stage, count(*) AS runs, count(*) FILTER (event_type = 'failure') AS failures, round(avg(CAST(event_type = 'failure' AS INT)), 6) AS failure_rate, {S.six('avg(d)')} AS avg_ms, max(d) AS max_ms, "
    f"{_quantile(0.5)} AS p50_ms, {_quantile(0.95)} AS p95_ms FROM (SELECT *, CASE WHEN d IS NOT NULL THEN row_number() OVER (PARTITION BY stage ORDER BY d NULLS LAST) END AS rn, "
    f"count(d) OVER (PARTITION BY stage) AS total FROM ({_CLOSED})) GROUP BY 1",
)
def stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.stage_latency(Inputs(spark, sf).trace_events)


STATUS_SQL = (
    "SELECT trace_id, stage, CASE WHEN bool_or(event_type = 'failure') THEN 'failed' WHEN bool_or(event_type = 'stage_end') THEN 'done' WHEN bool_or(event_type = 'stage_start') THEN 'active' ELSE 'pending' END AS status "
    f"FROM ({TRACES}) GROUP BY 1, 2"
)


@query(
    "stage_status",
    "N3",
    f"SELECT w.trace_id, w.stage, coalesce(s.status, 'pending') AS status FROM (SELECT trace_id, unnest([{', '.join(S.quoted(s) for s in V.TRACE_STAGES)}]) AS stage FROM (SELECT DISTINCT trace_id FROM ({TRACES}))) w "
    f"LEFT JOIN ({STATUS_SQL}) s USING (trace_id, stage)",
)
def stage_status(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.stage_status(Inputs(spark, sf).trace_events)


@query(
    "trace_timeline",
    "N4",
    f"SELECT trace_id, seq, stage, event_type FROM ({TRACES}) WHERE event_type <> 'metric'",
)
def trace_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.timeline(Inputs(spark, sf).trace_events).select("trace_id", "seq", "stage", "event_type")


@query(
    "token_usage",
    "N5",
    "SELECT 't' || event_id // 20 AS trace_id, CASE WHEN event_id % 2 = 0 THEN 'llm_generate' ELSE 'llm_stream' END AS stage, event_type AS model, count(*) AS calls, "
    "CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(user_id) AS BIGINT) AS completion_tokens FROM events GROUP BY 1, 2, 3",
)
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    calls = Inputs(spark, sf).events.select(
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 20)).alias("trace_id"),
        F.when(F.col("event_id") % 2 == 0, "llm_generate").otherwise("llm_stream").alias("stage"),
        F.col("event_type").alias("model"),
        F.from_json("props", "k long")["k"].alias("prompt_tokens"),
        F.col("user_id").alias("completion_tokens"),
    )
    return telemetry.token_usage(calls)


@query(
    "request_metrics",
    "N6",
    "SELECT path, method, count(*) AS requests, count(*) FILTER (code >= 400) AS errors, " + S.six("avg(CAST(code >= 400 AS INT))") + " AS error_share, " + S.six("avg(value)") + " AS avg_ms, "
    "min(value) FILTER (rn >= ceil(0.5 * total)) AS p50_ms, min(value) FILTER (rn >= ceil(0.95 * total)) AS p95_ms FROM (SELECT *, row_number() OVER (PARTITION BY path, method ORDER BY value) AS rn, "
    "count(*) OVER (PARTITION BY path, method) AS total FROM (SELECT '/' || event_type AS path, CASE WHEN user_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, "
    "CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 429 ELSE 200 END AS code, value FROM events)) GROUP BY 1, 2",
)
def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    requests = Inputs(spark, sf).events.select(
        F.concat(F.lit("/"), "event_type").alias("path"),
        F.when(F.col("user_id") % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 17 == 0, 429).otherwise(200).alias("status_code"),
        F.col("value").alias("duration_ms"),
    )
    return telemetry.request_metrics(requests)


@query(
    "event_history",
    "N7",
    S.with_(
        "chunks",
        "SELECT name, count(*) AS events, min(at_us) AS first_us, max(at_us) AS last_us FROM (SELECT 'DocumentImported' AS name, 0 AS at_us FROM docs UNION ALL SELECT 'EmbeddingCreated', 0 FROM chunks UNION ALL "
        "SELECT CASE event_type WHEN 'click' THEN 'ConversationStarted' WHEN 'view' THEN 'ReasoningCompleted' WHEN 'error' THEN 'MemoryUpdated' ELSE 'ProjectSaved' END, epoch_us(ts) FROM events) GROUP BY 1",
    ),
)
def event_history(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    imported = ingest.ingest_events(i.ingested.documents, i.ingested.chunks).select(
        "name", F.timestamp_seconds(F.lit(0)).alias("occurred_at")
    )
    name = F.expr(
        "CASE event_type WHEN 'click' THEN 'ConversationStarted' WHEN 'view' THEN 'ReasoningCompleted' "
        "WHEN 'error' THEN 'MemoryUpdated' ELSE 'ProjectSaved' END"
    )
    log = imported.unionByName(i.events.select(name.alias("name"), F.col("ts").alias("occurred_at")))
    return telemetry.event_history(log).select(
        "name", "events", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us")
    )
