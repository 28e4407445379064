"""Cross-source comparison.  Groups are one query's sources, bounded by its top_k plus
its web rows, so pairing them inside one row is safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import text as T


def row_source_key() -> Column:
    return T.source_key(F.col("document_id"), F.col("url"), F.col("chunk_id"))


def source_tokens(retrieved: DataFrame) -> DataFrame:
    """(query_id, source, first_rank, tokens): token union over a source's chunks."""
    keyed = retrieved.select(
        "query_id", "rank", row_source_key().alias("source"), T.tokens(F.col("chunk_text")).alias("tokens")
    )
    return keyed.groupBy("query_id", "source").agg(
        F.min("rank").alias("first_rank"),
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"),
    )


def _pairs(sources: Column) -> Column:
    """Every source with each later one: positions, names and token counts, no tokens."""

    def with_later(a: Column, i: Column) -> Column:
        later = F.slice(sources, i + 2, F.size(sources))
        return F.transform(
            later,
            lambda b, step: F.struct(
                (i + 1).alias("position_a"),
                (i + step + 2).alias("position_b"),
                a["source"].alias("source_a"),
                b["source"].alias("source_b"),
                F.size(a["tokens"]).alias("n_a"),
                F.size(b["tokens"]).alias("n_b"),
                F.size(F.array_intersect(a["tokens"], b["tokens"])).alias("shared"),
            ),
        )

    return F.flatten(F.transform(sources, with_later))


def compare_sources(retrieved: DataFrame) -> DataFrame:
    """Jaccard overlap of every pair of sources of a query, in order of appearance."""
    ordered = source_tokens(retrieved).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("first_rank", "source", "tokens"))).alias("sources")
    )
    pairs = ordered.select("query_id", F.inline(_pairs(F.col("sources"))))
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    overlap = F.when(union > 0, F.col("shared") / union).otherwise(F.lit(0.0))
    return pairs.select(
        "query_id",
        "position_a",
        "position_b",
        "source_a",
        "source_b",
        T.six(overlap).alias("overlap_ratio"),
        F.when(overlap >= V.AGREEMENT_THRESHOLD, "agreement").otherwise("divergence").alias("relation"),
    )


def divergence_counts(queries: DataFrame, comparisons: DataFrame) -> DataFrame:
    counted = comparisons.groupBy("query_id").agg(
        F.count_if(F.col("relation") == "divergence").alias("divergent")
    )
    return queries.select("query_id").join(counted, "query_id", "left").select(
        "query_id", F.coalesce("divergent", F.lit(0)).alias("divergent_phrasing_count")
    )


def references(retrieved: DataFrame) -> DataFrame:
    """First chunk of each source, numbered in order of appearance."""
    keyed = retrieved.withColumn("source", row_source_key())
    first = keyed.groupBy("query_id", "source").agg(
        F.min_by(F.struct("rank", "document_id", "document_title", "source_type", "url"), "rank").alias("r")
    )
    order = Window.partitionBy("query_id").orderBy("r.rank")
    return first.select(
        "query_id",
        F.row_number().over(order).alias("position"),
        "source",
        "r.document_id",
        F.col("r.document_title").alias("title"),
        "r.source_type",
        "r.url",
    )


def source_map(refs: DataFrame, comparisons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the per-query source picture."""
    node_id = F.coalesce(F.nullif("document_id", F.lit("")), "url")
    nodes = (
        refs.withColumn("node_id", node_id)
        .groupBy("query_id", "node_id")
        .agg(F.min_by(F.struct("title", "source_type"), "position").alias("r"))
        .select(
            "query_id",
            "node_id",
            F.col("r.title").alias("name"),
            F.when(F.col("r.source_type") == "web", "document").otherwise("concept").alias("node_type"),
        )
    )
    edges = comparisons.select(
        "query_id",
        F.col("source_a").alias("source_id"),
        F.col("source_b").alias("target_id"),
        F.col("relation").alias("relationship_type"),
    )
    return nodes, edges
