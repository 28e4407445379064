"""Connected components as Spark jobs: hook every vertex to its smallest neighbour, let
pointers jump, contract the edges, repeat until none is left.

Minima are aggregated map-side before the shuffle and then joined back, so a vertex with
very many edges is no single task's work; joins of a hot vertex are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) → (id, root): root is the smallest id reachable.  Ids that appear in no edge
    between two different ids get no row.  Null ends are ignored; no edges, no rows."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        ends = edges.select(F.col("b").alias("id"), F.col("a").alias("to")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("to")))
        parent = ends.groupBy("id").agg(F.min("to").alias("root"))
        for _ in range(2):  # each jump halves the depth
            parent = stored(jump(parent, parent), "parents")
        edges = stored(contract(edges, parent), "edges")
        roots = parent if roots is None else stored(jump(roots, parent), "roots")
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots


def jump(child: DataFrame, parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("id").alias("root"), F.col("root").alias("higher"))
    return child.join(up, "root", "left").select("id", F.coalesce("higher", "root").alias("root"))


def contract(edges: DataFrame, parent: DataFrame) -> DataFrame:
    a = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    b = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    moved = edges.join(a, "a").join(b, "b").where("ra <> rb")
    return moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
