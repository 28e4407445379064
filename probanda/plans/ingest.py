"""Uploads to stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import Parser, check_uploads, derive_tables, ingest_events


def store_uploads(
    uploads: DataFrame,
    out: str,
    batch: str | int,
    parsers: dict[str, Parser] | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write one batch of documents, concepts, edges, chunks, rejected and bus_events
    below ``out``, each to the batch's own folder; running a batch again replaces it.

    The raw bytes are read and cleaned once, into ``out``/checked; every table is then
    derived from that one, reading only the columns it needs.  ``out``/commits names the
    batch when all its tables are whole, and not while it is written or written again:
    ``read_committed`` shows all of a batch or nothing.
    """
    spark = uploads.sparkSession
    folder = f"batch={batch}"

    def mark(committed: bool) -> None:
        rows = spark.range(1 if committed else 0).withColumn("committed_at", F.current_timestamp())
        rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/{folder}")

    mark(False)
    check_uploads(uploads, parsers).write.mode("overwrite").parquet(f"{out}/checked/{folder}")
    done = derive_tables(spark.read.parquet(f"{out}/checked/{folder}"))
    tables = {
        "documents": done.documents,
        "concepts": done.concepts,
        "edges": done.edges,
        "chunks": embed(done.chunks) if embed else done.chunks,
        "rejected": done.rejected,
    }
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}/{folder}")
    # from the stored chunks: events tell what was embedded, and the embedder runs once
    chunks = spark.read.parquet(f"{out}/chunks/{folder}")
    ingest_events(done.documents, chunks).write.mode("overwrite").parquet(f"{out}/bus_events/{folder}")
    mark(True)


def read_committed(spark: SparkSession, out: str, table: str, keep_batch: bool = False) -> DataFrame:
    """A table of the committed batches."""
    whole = spark.read.parquet(f"{out}/commits").select(F.col("batch").cast("string").alias("batch")).distinct()
    rows = spark.read.parquet(f"{out}/{table}").withColumn("batch", F.col("batch").cast("string")).join(whole, "batch", "left_semi")
    return rows if keep_batch else rows.drop("batch")
