"""The given tables in the shapes the operators take."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..functions import vectors as VF
from ..operators import ingest as ingest_ops
from ..plans.ask import Knowledge
from ..session import SMALL_GROUPS, ship_package, stored


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table that arrives in fewer splits than there are cores to all cores.  A
    large table already has more splits and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ship_package(spark), sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the zone of the given times
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # --- documents ----------------------------------------------------------
    @cached_property
    def documents_raw(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text", "lang", "source"), "doc_id")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
        )

    @cached_property
    def uploads(self) -> DataFrame:
        return self.documents_raw.select(
            F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
            F.concat("doc_id", F.lit(".txt")).alias("filename"),
            F.encode("text", "utf-8").alias("content"),
            F.timestamp_seconds("doc_id").alias("created_at"),
            F.col("doc_id").alias("ingest_order"),
            F.col("source").alias("project_id"),
        )

    @cached_property
    def ingested(self) -> ingest_ops.Ingested:
        return ingest_ops.ingest(self.uploads)

    @cached_property
    def chunks(self) -> DataFrame:
        """Every chunk of every document, with the vector of its document; where that has
        none, with one made from the chunk's text.  Written once: a search reads vectors first
        and texts later, each without the other, and executors hold none of the table."""
        vectors = self.vectors.select(F.col("vec_id").alias("ingest_order"), "embedding")
        given = self.uploads.join(vectors, "ingest_order", "left")
        chunks = ingest_ops.ingest(given, carry=["embedding"]).chunks
        chunks = chunks.withColumn("embedding", F.coalesce("embedding", VF.digest_embedding(F.col("chunk_text"))))
        return stored(chunks, "chunks", compression="zstd", **SMALL_GROUPS)

    @cached_property
    def documents(self) -> DataFrame:
        return self.ingested.documents

    @cached_property
    def concepts(self) -> DataFrame:
        return self.ingested.concepts

    @cached_property
    def edges(self) -> DataFrame:
        """derived_from edges of the ingest, concept–concept and document–project edges,
        and hub concepts that every tenth document points at."""
        docs = self.table("documents").select("doc_id", "source")
        path = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))
        concept, document = T.stable_id(F.lit("concept"), path), T.stable_id(F.lit("document"), path)
        ids = docs.select("doc_id", "source", concept.alias("concept"), document.alias("document"))
        hub = ids.where("doc_id % 1000 = 0").select(F.col("doc_id").alias("hub_id"), F.col("concept").alias("hub"))

        def edge(rows: DataFrame, kind: str, st: str, sid: str, tt: str, tid: str) -> DataFrame:
            return rows.select(
                T.stable_id(F.lit(kind), F.col(sid), F.col(tid)).alias("id"),
                F.lit(st).alias("source_type"), F.col(sid).alias("source_id"),
                F.lit(tt).alias("target_type"), F.col(tid).alias("target_id"),
                F.lit(kind).alias("relationship_type"), F.timestamp_seconds("doc_id").alias("created_at"),
            )

        later = ids.select((F.col("doc_id") - 20).alias("doc_id"), F.col("concept").alias("next"))
        related = ids.join(later, "doc_id")
        tenth = ids.where("doc_id % 10 = 3").withColumn("hub_id", F.col("doc_id") - F.col("doc_id") % 1000)
        pointing = tenth.join(hub, "hub_id")
        return (
            self.ingested.edges
            .unionByName(edge(related, "related_to", "concept", "concept", "concept", "next"))
            .unionByName(edge(ids, "belongs_to", "document", "document", "project", "source"))
            .unionByName(edge(pointing, "references", "document", "document", "concept", "hub"))
        )

    @cached_property
    def projects(self) -> DataFrame:
        return self.table("documents").groupBy(F.col("source").alias("id")).agg(
            F.concat(F.lit("Project "), "source").alias("name"),
            F.concat(F.lit("Documents from "), "source").alias("description"),
            F.timestamp_seconds(F.min("doc_id")).alias("created_at"),
        )

    @cached_property
    def knowledge(self) -> Knowledge:
        return Knowledge(self.chunks, self.concepts, self.edges, self.projects)

    # --- queries ---------------------------------------------------------------
    def _queries(self, text: Column, bare: Column | None = None) -> DataFrame:
        """Every item; with ``bare``, once more with that text, under a negative id."""
        given = self.table("benchmark").select("item_id", text.alias("text"), F.col("item_id").alias("vec_id"))
        if bare is not None:
            again = self.table("benchmark").select((-1 - F.col("item_id")).alias("item_id"), bare.alias("text"), F.col("item_id").alias("vec_id"))
            given = given.unionByName(again)
        items = given.join(self.vectors, "vec_id")
        return items.select(
            F.col("item_id").cast("string").alias("query_id"),
            F.col("text").alias("query"),
            "embedding",
            F.col("item_id").cast("string").alias("session_id"),
            F.concat(F.lit("src"), F.col("item_id") % 20).alias("project_id"),
            (F.col("item_id") % 3 == 0).alias("use_web"),
            F.timestamp_seconds(F.col("item_id") * 60).alias("asked_at"),
            "item_id",
            "label",
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self._queries(F.col("text"))

    @cached_property
    def asked(self) -> DataFrame:
        """The same items as utterances of many kinds, and one too short to answer for each."""
        t = F.col("text")
        kind = F.col("item_id") % 8
        return self._queries(
            F.when(kind == 1, F.concat(t, F.lit("?")))
            .when(kind == 2, F.concat(F.lit("Why "), t))
            .when(kind == 3, F.concat(t, F.lit(" and "), t))
            .when(kind == 6, F.concat(F.lit("create "), t))
            .when(kind == 7, F.concat(F.lit("How "), t, F.lit(" compared to  "), t))
            .otherwise(t),
            F.when(F.col("item_id") % 2 == 0, F.lit("it")).otherwise(F.lit("   ")),
        )

    @cached_property
    def web_results(self) -> DataFrame:
        """Every page as a result of one of the first forty items."""
        pages = self.table("pages")
        return pages.select(
            (F.col("page_id") % 40).cast("string").alias("query_id"),
            F.floor(F.col("page_id") / 40).alias("position"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            "url",
            F.regexp_replace("html", "<[^>]*>", " ").alias("content"),
            (1 / (F.floor(F.col("page_id") / 40) + 2)).alias("score"),
        )

    # --- conversations -----------------------------------------------------------
    @cached_property
    def history(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content")
        )

    @cached_property
    def questions(self) -> DataFrame:
        rows = self.table("conversations").where("role = 'user'")
        return rows.select(
            F.concat(F.lit("q"), "conv_id", F.lit("."), "turn").alias("id"),
            F.col("conv_id").cast("string").alias("session_id"),
            F.lit(None).cast("string").alias("conversation_id"),
            "text",
            F.timestamp_seconds(F.col("turn") * 60).alias("created_at"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Each assistant turn answers the turn before; its sources are stored as JSON."""
        rows = self.table("conversations").where("role = 'assistant'")
        listed = (
            '[{"document_id":"d%d","title":"t","source_type":"local","url":null,"concept_id":"c%d"},'
            '{"document_id":"","title":"t%d","source_type":"web","url":"u%d","concept_id":null}]'
        )
        number = F.col("conv_id") % 7 + F.col("turn")
        return rows.select(
            F.concat(F.lit("a"), "conv_id", F.lit("."), "turn").alias("id"),
            F.concat(F.lit("q"), "conv_id", F.lit("."), F.col("turn") - 1).alias("question_id"),
            "text",
            (F.col("turn") / 10).alias("confidence"),
            F.when(F.col("turn") % 4 == 3, F.lit("[]"))
            .otherwise(F.format_string(listed, number, number % 3, F.col("turn"), F.col("turn") % 2))
            .alias("sources"),
            F.timestamp_seconds(F.col("turn") * 60).alias("created_at"),
        )

    # --- events ---------------------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return spread(self.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "event_id")

    @cached_property
    def requests(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("request_id"),
            F.col("user_id").cast("string").alias("identity"),
            F.unix_micros("ts").alias("at_us"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def trace_events(self) -> DataFrame:
        """Five events to a trace; every second closing event lacks its duration."""
        kind = F.expr(
            "CASE event_type WHEN 'click' THEN 'stage_start' WHEN 'view' THEN 'stage_end' "
            "WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'metric' ELSE 'stage_start' END"
        )
        stages = F.array(*[F.lit(s) for s in [*V.TRACE_STAGES, "llm_generate"]])
        return self.events.select(
            F.concat(F.lit("t"), F.floor(F.col("event_id") / 20)).alias("trace_id"),
            F.col("event_id").alias("seq"),
            F.get(stages, (F.col("user_id") % 7).cast("int")).alias("stage"),
            kind.alias("event_type"),
            F.col("ts").alias("timestamp"),
            F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("duration_ms"),
            F.col("props").alias("metadata"),
        )
