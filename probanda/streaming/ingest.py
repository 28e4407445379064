"""Documents as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ingest import Parser
from ..plans.ingest import read_committed, store_uploads
from ..sources.files import BINARY_FILE_SCHEMA, upload_columns


def stream_uploads(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New raw files below ``path`` in the layout of ``sources.files.read_uploads``."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return upload_columns(reader.option("recursiveFileLookup", "true").load(path))


def stream_table(spark: SparkSession, folder: str, schema: str, glob: str | None = None) -> DataFrame:
    """New Parquet files in ``folder``, optionally only those whose name matches."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def ingest_stream(
    uploads: DataFrame,
    out: str,
    checkpoint: str,
    parsers: dict[str, Parser] | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Store each micro-batch as a batch of its own: documents, concepts, edges, chunks,
    rejected and bus_events below ``out``.  Batches are named by the stream's checkpoint and
    their number, so streams that share ``out`` do not replace each other's; read the
    tables with ``read_committed``."""
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def store(batch: DataFrame, batch_id: int) -> None:
        store_uploads(batch, out, f"{stream}.{batch_id}", parsers, embed)

    writer = uploads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
