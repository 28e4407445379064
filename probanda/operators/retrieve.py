"""Hybrid retrieval, web evidence, sub-question search and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import text as T
from .ranking import BLOCK_QUERIES, rank_chunks

RETRIEVED = [
    "query_id", "rank", "chunk_id", "document_id", "document_title", "chunk_text", "score",
    "semantic_score", "keyword_score", "concept_id", "url", "source_type",
]


def prepare_queries(queries: DataFrame) -> DataFrame:
    """queries(query_id, query, embedding[, document_id, top_k, min_score]) with the
    normalised text and its tokens; blank queries drop out, they retrieve nothing."""
    defaults = {
        "document_id": F.lit(None).cast("string"),
        "top_k": F.lit(V.TOP_K),
        "min_score": F.lit(V.MIN_SCORE),
    }
    for name, value in defaults.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, value)
    return (
        queries.withColumn("normalized", T.normalize_query(F.col("query")))
        .where("normalized <> ''")
        .select(
            F.col("query_id").cast("string").alias("query_id"),
            "normalized",
            T.tokens(F.col("normalized")).alias("tokens"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            "document_id",
            F.col("top_k").cast("int").alias("top_k"),
            F.col("min_score").cast("double").alias("min_score"),
        )
    )


def add_titles(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """Left lookup of document titles; a missing document leaves a null title."""
    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return ranked.drop("document_title").join(titles, "document_id", "left")


def _local(ranked: DataFrame, documents: DataFrame | None) -> DataFrame:
    return (
        (ranked if documents is None else add_titles(ranked, documents))
        .withColumns(
            {
                "score": T.six(F.col("score")),
                "semantic_score": T.six(F.col("semantic_score")),
                "keyword_score": T.six(F.col("keyword_score")),
                "url": F.lit(None).cast("string"),
                "source_type": F.lit("local"),
            }
        )
        .select(*RETRIEVED)
    )


def retrieve(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """Top chunks of every query by 0.7·cosine + 0.3·keyword share.

    Documents never change once imported, so ingest keeps their title with each chunk
    and no lookup is needed.  For chunks stored without titles pass ``documents``.
    """
    ranked = rank_chunks(prepare_queries(queries), chunks, block_queries=block_queries, filtered="document_id" in queries.columns)
    return _local(ranked, documents)


def retrieve_reusing(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """As ``retrieve``, scoring each distinct (text, top_k, document, min_score) once.

    Adds ``reused``: false for the query that was scored, true for its repeats.
    """
    prepared = prepare_queries(queries)
    key = ["normalized", "top_k", "document_id", "min_score"]
    keyed = prepared.withColumn(
        "request",
        F.sha2(F.concat_ws("|", "normalized", "top_k", F.coalesce("document_id", F.lit("")), "min_score"), 256),
    )
    first = keyed.groupBy("request", *key).agg(
        F.min("query_id").alias("first_query"),
        F.min_by("embedding", "query_id").alias("embedding"),
        F.min_by("tokens", "query_id").alias("tokens"),
    )
    ranked = rank_chunks(first.withColumnRenamed("request", "query_id"), chunks, block_queries=block_queries, filtered="document_id" in queries.columns)
    answers = _local(ranked, documents).withColumnRenamed("query_id", "request")
    owners = keyed.select("query_id", "request").join(
        first.select("request", "first_query"), "request"
    )
    return owners.join(answers, "request").select(
        *RETRIEVED, (F.col("query_id") != F.col("first_query")).alias("reused")
    )


def vector_top_k(queries: DataFrame, chunks: DataFrame, top_k: int = V.TOP_K) -> DataFrame:
    """Cosine ranking alone: no keyword part and no score floor."""
    prepared = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.array().cast("array<string>").alias("tokens"),
        F.lit(None).cast("string").alias("document_id"),
        F.lit(top_k).alias("top_k"),
        F.lit(float("-inf")).alias("min_score"),
    )
    ranked = rank_chunks(prepared, chunks, semantic_weight=1.0, keyword_weight=0.0, filtered=False)
    return ranked.select("query_id", "rank", "chunk_id", "document_id", "chunk_text", T.six(F.col("score")).alias("score"))


def web_evidence(
    queries: DataFrame, web_results: DataFrame | None, max_results: int = V.WEB_RESULTS
) -> DataFrame:
    """First results of each query that asked for the web and is not blank.

    ``web_results(query_id, position, title, url, content, score)``; None means no
    search is configured and yields no row.  The row_number filter plans as a group
    limit, so a query with very many results is cut inside each map task.
    """
    if web_results is None:
        empty = ", ".join(f"{n} string" for n in RETRIEVED)
        return queries.sparkSession.createDataFrame([], empty).withColumns(
            {n: F.col(n).cast("double") for n in ("score", "semantic_score", "keyword_score")}
        ).withColumn("rank", F.col("rank").cast("int"))
    asking = queries.where(F.col("use_web") & (T.normalize_query(F.col("query")) != "")).select(
        F.col("query_id").cast("string").alias("query_id")
    )
    order = Window.partitionBy("query_id").orderBy("position", "url")
    best = (
        web_results.withColumn("query_id", F.col("query_id").cast("string"))
        .join(asking, "query_id", "left_semi")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max_results)
    )
    score = T.six(F.coalesce("score", F.lit(0.0)))
    return best.select(
        "query_id",
        "rank",
        T.stable_id(F.lit("web"), F.col("query_id"), F.col("position"), F.coalesce("url", F.lit(""))).alias("chunk_id"),
        F.lit(None).cast("string").alias("document_id"),
        F.coalesce("title", F.lit("Untitled")).alias("document_title"),
        F.coalesce("content", F.lit("")).alias("chunk_text"),
        score.alias("score"),
        score.alias("semantic_score"),
        F.lit(0.0).alias("keyword_score"),
        F.lit(None).cast("string").alias("concept_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.lit("web").alias("source_type"),
    )


def append_web(local: DataFrame, web: DataFrame) -> DataFrame:
    """Web rows after the local rows of their query.  Both sides are bounded per query,
    and one renumbering of their union reads each of them once."""
    order = Window.partitionBy("query_id").orderBy(F.col("source_type") == "web", "rank")
    both = local.select(*RETRIEVED).unionByName(web.select(*RETRIEVED))
    return both.withColumn("rank", F.row_number().over(order))


def explode_sub_questions(questions: DataFrame) -> DataFrame:
    """questions(query_id, query, …) to one row per part, keyed query_id#part."""
    parts = F.posexplode(T.sub_questions(F.col("query"))).alias("part", "sub_question")
    others = [c for c in questions.columns if c not in ("query_id", "query")]
    return questions.select(F.col("query_id").alias("question_id"), *others, parts).select(
        "question_id",
        "part",
        F.concat_ws("#", "question_id", "part").alias("query_id"),
        F.col("sub_question").alias("query"),
        *others,
    )


def merge_sub_results(found: DataFrame) -> DataFrame:
    """Best-scoring occurrence of each chunk per question, in order of first appearance.

    ``found`` is a retrieval over parts keyed query_id#part.
    """
    split = found.withColumns(
        {
            "question_id": F.regexp_extract("query_id", "^(?s)(.*)#([0-9]+)$", 1),
            "part": F.regexp_extract("query_id", "^(?s)(.*)#([0-9]+)$", 2).cast("int"),
        }
    )
    payload = F.struct(*[c for c in RETRIEVED if c not in ("query_id", "rank", "chunk_id")])
    merged = split.groupBy("question_id", "chunk_id").agg(
        F.min(F.struct("part", "rank")).alias("first_seen"),
        F.min_by(payload, F.struct(-F.col("score"), F.col("part"), F.col("rank"))).alias("kept"),
    )
    order = Window.partitionBy("question_id").orderBy("first_seen")
    return merged.select(
        F.col("question_id").alias("query_id"),
        F.row_number().over(order).alias("rank"),
        "chunk_id",
        "kept.*",
    ).select(*RETRIEVED)


def merge_sub_web(web: DataFrame) -> DataFrame:
    """Web rows of all parts of a question in part order, repeats kept."""
    split = web.withColumns(
        {
            "question_id": F.regexp_extract("query_id", "^(?s)(.*)#([0-9]+)$", 1),
            "part": F.regexp_extract("query_id", "^(?s)(.*)#([0-9]+)$", 2).cast("int"),
        }
    )
    order = Window.partitionBy("question_id").orderBy("part", "rank")
    return split.withColumn("rank", F.row_number().over(order)).withColumn(
        "query_id", F.col("question_id")
    ).select(*RETRIEVED)


def retrieval_accuracy(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(query_id, expected_label) against the label of the rank-1 document,
    ``retrieved`` carrying found_label; one row per label and one for all."""
    top = retrieved.where("rank = 1").select("query_id", "found_label")
    hits = expected.join(top, "query_id", "left").select(
        F.col("expected_label").cast("string").alias("expected_label"),
        F.coalesce((F.col("found_label") == F.col("expected_label")).cast("int"), F.lit(0)).alias("hit"),
    )
    measured = hits.rollup("expected_label").agg(
        F.count("*").alias("queries"),
        F.sum("hit").alias("hits"),
        T.six(F.avg("hit")).alias("accuracy"),
    )
    return measured.select(
        F.coalesce("expected_label", F.lit("all")).alias("label"),
        "queries",
        "hits",
        "accuracy",
        (F.col("accuracy") >= V.ACCURACY_FLOOR).alias("meets_floor"),
    )


def retrieval_telemetry(queries: DataFrame, reusing: DataFrame) -> DataFrame:
    """Per query: was the result reused, how many chunks, the top score.  A query
    without a result keeps its row, and counts as scored."""
    seen = reusing.groupBy("query_id").agg(
        F.bool_or("reused").alias("cache_hit"),
        F.count("*").alias("chunk_count"),
        F.max("score").alias("top_score"),
    )
    ids = queries.select(F.col("query_id").cast("string").alias("query_id"))
    return ids.join(seen, "query_id", "left").select(
        "query_id",
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        "top_score",
    )
