"""Edges, concept neighbourhoods and the concept graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .assembly import joined, text_digest

EDGE_COLUMNS = [
    "id", "source_type", "source_id", "target_type", "target_id", "relationship_type", "created_at",
]
# ":" " --" "--> " ":" around six possibly empty fields
SHORTEST_EDGE_LINE = 9


def edge_line() -> Column:
    return F.format_string(
        "%s:%s --%s--> %s:%s", "source_type", "source_id", "relationship_type", "target_type", "target_id"
    )


def edges_of(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an entity at either end, each edge once per entity.

    entities(entity_type, entity_id) holds distinct rows.  Two equi-joins instead of one
    OR condition, which could only run as a pairwise comparison of both tables.
    """
    table = edges.select(*EDGE_COLUMNS)
    as_source = table.join(
        entities,
        (F.col("source_type") == F.col("entity_type")) & (F.col("source_id") == F.col("entity_id")),
    )
    as_target = table.where(
        ~((F.col("source_type") == F.col("target_type")) & (F.col("source_id") == F.col("target_id")))
    ).join(
        entities,
        (F.col("target_type") == F.col("entity_type")) & (F.col("target_id") == F.col("entity_id")),
    )
    return as_source.unionByName(as_target)


def retrieved_concepts(retrieved: DataFrame) -> DataFrame:
    return retrieved.where("concept_id is not null and concept_id <> ''").select("query_id", "concept_id").distinct()


def concept_edges(retrieved: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of every retrieved concept; an edge between two of them appears twice."""
    wanted = retrieved_concepts(retrieved)
    entities = wanted.select(F.lit("concept").alias("entity_type"), F.col("concept_id").alias("entity_id")).distinct()
    found = edges_of(entities, edges).withColumnRenamed("entity_id", "concept_id").drop("entity_type")
    return wanted.join(found, "concept_id")


def concept_ends(edges: DataFrame) -> DataFrame:
    """Every edge once for each concept it touches, in one scan of the edges."""
    ends = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"{end}_type") == "concept", F.col(f"{end}_id")) for end in ("source", "target")])))
    return edges.select(*EDGE_COLUMNS, F.explode(ends).alias("concept_id"))


def concept_edge_text(edges: DataFrame) -> DataFrame:
    """(concept_id, n_items, n_chars, text): the whole edge text of every concept, in order
    of creation.  Lines of one hour are joined first, so the lines of a concept with very
    many edges are assembled by many tasks; only its finished text is one row."""
    lines = concept_ends(edges).select("concept_id", "created_at", "id", edge_line().alias("line"))
    pieces = lines.groupBy("concept_id", F.date_trunc("hour", "created_at").alias("hour")).agg(
        F.count("*").alias("n_items"), joined(["created_at", "id"], "line", "\n").alias("piece")
    )
    whole = pieces.groupBy("concept_id").agg(F.sum("n_items").alias("n_items"), joined(["hour"], "piece", "\n").alias("text"))
    return whole.select("concept_id", "n_items", F.length("text").cast("long").alias("n_chars"), "text")


def concept_edge_digest(edges: DataFrame, limit: int, concepts: DataFrame | None = None) -> DataFrame:
    """Per concept: number of edges, full text length and the first ``limit`` characters
    of its edge text.  What a query needs of a concept with very many edges is this row,
    not the edges.  ``concepts(concept_id)``, distinct, restricts the work to those."""
    if concepts is not None:
        entities = concepts.select(F.lit("concept").alias("entity_type"), F.col("concept_id").alias("entity_id"))
        ends = edges_of(entities, edges).withColumnRenamed("entity_id", "concept_id")
    else:
        ends = concept_ends(edges)
    lines = ends.select("concept_id", "created_at", "id", edge_line().alias("line"))
    return text_digest(lines, ["concept_id"], ["created_at", "id"], "line", "\n", limit, SHORTEST_EDGE_LINE)


def definitions(retrieved: DataFrame, concepts: DataFrame) -> DataFrame:
    """Retrieved concepts that exist, numbered by id within the query."""
    known = retrieved_concepts(retrieved).join(
        concepts.select(F.col("id").alias("concept_id"), "name", "description"), "concept_id"
    )
    order = Window.partitionBy("query_id").orderBy("concept_id")
    return known.select("query_id", F.row_number().over(order).alias("position"), "concept_id", "name", "description")


def concept_graph(concepts: DataFrame, edges: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All concepts plus the documents on a concept edge, and those edges."""
    kept = edges.where("source_type = 'concept' or target_type = 'concept'").select(*EDGE_COLUMNS)
    touched = (
        kept.where("source_type = 'document'").select(F.col("source_id").alias("id"))
        .unionByName(kept.where("target_type = 'document'").select(F.col("target_id").alias("id")))
        .distinct()
    )
    nodes = concepts.select("id", "name", F.lit("concept").alias("node_type")).unionByName(
        documents.join(touched, "id", "left_semi").select(
            "id", F.col("title").alias("name"), F.lit("document").alias("node_type")
        )
    )
    return nodes, kept
