"""Embedding and vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions import vectors as VF
from ..operators import embed, retrieve
from . import sql as S
from .inputs import Inputs
from .registry import query


def length_embedder():
    """A fixture embedder; texts whose length is a multiple of 13 fail."""

    def run(texts: list[str]) -> list[list[float]]:
        if any(len(t) % 13 == 0 for t in texts):
            raise ValueError("no vector")
        return [[len(t) % 7, len(t) % 3, 1.0] for t in texts]

    return run


@query(
    "embed_with_function",
    "D1",
    "SELECT doc_id, CASE WHEN ok THEN CAST(n % 7 AS DOUBLE) END AS v1, CASE WHEN ok THEN CAST(n % 3 AS DOUBLE) END AS v2, NOT ok AS failed "
    "FROM (SELECT doc_id, length(text) AS n, length(text) % 13 <> 0 AS ok FROM documents)",
)
def embed_with_function(spark: SparkSession, sf: str) -> DataFrame:
    done = embed.embed(Inputs(spark, sf).documents_raw.select("doc_id", "text"), "text", length_embedder)
    return done.select(
        "doc_id",
        F.get("embedding", F.lit(0)).alias("v1"),
        F.get("embedding", F.lit(1)).alias("v2"),
        F.col("embed_error").isNotNull().alias("failed"),
    )


@query(
    "embed_only_new",
    "D2",
    "SELECT doc_id, reused, CASE WHEN reused OR n % 13 <> 0 THEN CAST(n % 7 AS DOUBLE) END AS v1 FROM (SELECT doc_id, length(text) AS n, "
    "text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS reused FROM documents)",
)
def embed_only_new(spark: SparkSession, sf: str) -> DataFrame:
    docs = Inputs(spark, sf).documents_raw.select("doc_id", "text")
    store = docs.where("doc_id % 2 = 0").select(
        F.sha2("text", 256).alias("text_hash"), VF.length_embedding(F.col("text")).alias("embedding")
    ).dropDuplicates(["text_hash"])
    done = embed.embed_new(docs, "text", store, length_embedder)
    return done.select("doc_id", "reused", F.get("embedding", F.lit(0)).alias("v1"))


@query(
    "cosine_similarity",
    "D3",
    "SELECT a.vec_id, " + S.six("CASE WHEN a.vec_id % 10 = 0 THEN 0.0 ELSE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) END")
    + " AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    v = Inputs(spark, sf).vectors.select("vec_id", "embedding")
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    a = v.select("vec_id", F.when(F.col("vec_id") % 10 == 0, zero).otherwise(F.col("embedding")).alias("a"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", T.six(VF.cosine(F.col("a"), F.col("b"))).alias("cosine"))


@query(
    "vector_top_k",
    "D4",
    S.with_(
        "queries vchunks",
        f"SELECT query_id, CAST(rn AS BIGINT) AS rank, chunk_id, {S.six('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, chunk_id) AS rn FROM "
        f"(SELECT q.query_id, c.chunk_id, c.doc_id, c.chunk_index, floor(list_cosine_similarity(q.embedding, c.embedding) * 1e12 + 0.5) / 1e12 AS score FROM queries q, vchunks c)) WHERE rn <= 5",
    ),
)
def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    found = retrieve.vector_top_k(i.queries, i.chunks)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


@query(
    "dimension_report",
    "D5",
    "SELECT CASE WHEN vec_id % 50 = 0 THEN 32 ELSE len(embedding) END AS dimension, count(*) AS vectors FROM embeddings GROUP BY 1",
)
def dimension_report(spark: SparkSession, sf: str) -> DataFrame:
    mixed = F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    rows = Inputs(spark, sf).vectors.select(mixed.alias("embedding"))
    return embed.dimension_report(rows).select(F.col("dimension").cast("long").alias("dimension"), "vectors")
