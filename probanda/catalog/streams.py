"""The streams, replayed from the given tables in time order.

Each replay writes a slice of the table to the watched folder and runs the stream on
what is new, several times, restarting from its checkpoint in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import streaming as ST

from ..schemas import TRACE_EVENTS
from ..session import shared_dir
from . import sql as S
from .inputs import Inputs
from .registry import query
from .telemetry import LIMIT, STATUS_SQL, WINDOW_SECONDS, admission_sql

SLICES = 3


def replay(slices: list[DataFrame], folder: str, start: Callable[[], StreamingQuery]) -> None:
    """State is spread over no more partitions than the cluster has cores: every one of
    them is a store of its own that each micro-batch opens and commits."""
    spark = slices[0].sparkSession
    setting, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), cores)))
    try:
        for rows in slices:
            rows.write.mode("append").parquet(folder)
            start().awaitTermination()
    finally:
        spark.conf.set(setting, before)


def in_time(rows: DataFrame, at: Column) -> list[DataFrame]:
    """Equal stretches of time."""
    first, last = rows.agg(F.min(at), F.max(at)).first()
    step = (last - first) // SLICES + 1
    return [rows.where(F.floor((at - first) / step) == n) for n in range(SLICES)]


@query(
    "ingest_as_files_arrive",
    "L1",
    S.with_(
        "chunks",
        "SELECT chunk_id, document_id, chunk_index, char_start, char_end, sha256(chunk_text) AS text_hash FROM chunks",
    ),
)
def ingest_as_files_arrive(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    root = shared_dir(spark, "ingest-stream")
    n = F.col("ingest_order") % SLICES
    schema = "path string, filename string, content binary, created_at timestamp, ingest_order long, project_id string"

    def start() -> StreamingQuery:
        uploads = ST.stream_table(spark, f"{root}/in", schema)
        return ST.ingest_stream(uploads, f"{root}/out", f"{root}/checkpoint")

    replay([i.uploads.where(n == k) for k in range(SLICES)], f"{root}/in", start)
    chunks = ST.read_committed(spark, f"{root}/out", "chunks")
    return chunks.select(
        "chunk_id", "document_id",
        *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "char_start", "char_end")],
        F.sha2("chunk_text", 256).alias("text_hash"),
    )


@query(
    "event_fan_out",
    "L2",
    "SELECT 'audit' AS subscriber, event_id, event_type AS name FROM events WHERE event_type IN ('error', 'signup') UNION ALL "
    "SELECT 'billing', event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')",
)
def event_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_dir(spark, "fan-out")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    log = ST.stream_table(spark, sf, schema, "events.parquet").select("event_id", F.col("event_type").alias("name"))
    wanted = {"audit": ["error", "signup"], "billing": ["purchase", "signup"]}
    ST.fan_out(log, wanted, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = [ST.read_batches(spark, f"{root}/out/{who}").select(F.lit(who).alias("subscriber"), "event_id", "name") for who in wanted]
    return got[0].unionByName(got[1])


@query(
    "admission_limit_stream",
    "L3",
    admission_sql(LIMIT, WINDOW_SECONDS) + "SELECT event_id AS request_id, ok AS admitted FROM r",
)
def admission_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    root = shared_dir(spark, "admission")

    def start() -> StreamingQuery:
        requests = ST.stream_table(spark, f"{root}/in", "request_id long, identity string, at_us long, seq long")
        decided = ST.admission_stream(requests, LIMIT, WINDOW_SECONDS)
        return ST.batch_sink(decided, f"{root}/checkpoint", lambda batch: {f"{root}/out": batch})

    replay(in_time(i.requests, F.col("at_us")), f"{root}/in", start)
    return ST.read_batches(spark, f"{root}/out").select("request_id", "admitted")


# Each assistant turn arrives word by word; its evidence is the turn before.
_STREAMED = "SELECT 'c' || conv_id || '.' || turn AS turn_id, text, turn, conv_id FROM conversations WHERE role = 'assistant'"


@query(
    "token_stream_assembly",
    "L4",
    f"SELECT turn_id, sha256(t) AS text_hash, delivered, CASE WHEN delivered THEN sha256(t) END AS delivered_hash FROM (SELECT *, turn % 4 = 1 AND conv_id % 2 = 1 AS delivered "
    f"FROM (SELECT *, text || CASE WHEN conv_id % 2 = 1 THEN ' uncertain' ELSE ' [Nowhere]' END AS t FROM ({_STREAMED})))",
)
def token_stream_assembly(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    root = shared_dir(spark, "tokens")
    turns = i.table("conversations").where("role = 'assistant'")
    ending = F.when(F.col("conv_id") % 2 == 1, " uncertain").otherwise(" [Nowhere]")
    words = F.split(F.concat("text", ending), "(?<= )")
    turn_id = F.concat(F.lit("c"), "conv_id", F.lit("."), "turn")
    tokens = turns.select(turn_id.alias("turn_id"), F.size(words).alias("n"), F.posexplode(words).alias("seq", "text")).select(
        "turn_id", F.col("seq").cast("long").alias("seq"), "text", (F.col("seq") == F.col("n") - 1).alias("is_last")
    )
    # evidence: turns 1, 5, … have confident evidence, the others a different kind of none
    good = F.col("turn") % 4 == 1
    reasons = turns.select(
        turn_id.alias("query_id"),
        F.array().cast("array<string>").alias("known_sources"),
        F.when(good, 3).otherwise(0).cast("long").alias("n_chunks"),
        F.when(good, 0.9).otherwise(0.2).alias("overall"),
        F.when(good, 0.9).otherwise(0.0).alias("agreement_among_sources"),
    )

    def start() -> StreamingQuery:
        arriving = ST.stream_table(spark, f"{root}/in", "turn_id string, seq long, text string, is_last boolean")
        return ST.deliver_streamed(ST.assemble_tokens(arriving), reasons, f"{root}/out", f"{root}/checkpoint")

    # pieces of one turn arrive in several batches and not in order
    replay([tokens.where(F.col("seq") % SLICES == n) for n in (1, 0, 2)], f"{root}/in", start)
    return ST.read_batches(spark, f"{root}/out").select(
        F.col("query_id").alias("turn_id"),
        F.sha2("response_text", 256).alias("text_hash"),
        "delivered",
        F.sha2("delivered_text", 256).alias("delivered_hash"),
    )


@query("live_stage_status", "L5", STATUS_SQL)
def live_stage_status(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    root = shared_dir(spark, "status")
    rows = i.trace_events.select(*[c.strip().split(" ")[0] for c in TRACE_EVENTS.split(",")])

    def start() -> StreamingQuery:
        events = ST.stream_table(spark, f"{root}/in", TRACE_EVENTS)
        return ST.live_stage_status(events, f"{root}/out", f"{root}/checkpoint")

    replay(in_time(rows, F.unix_micros("timestamp")), f"{root}/in", start)
    return ST.latest_status(ST.read_batches(spark, f"{root}/out", keep_batch=True))
