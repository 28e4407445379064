"""Uploads to documents, concepts, edges, chunks and bus events.

One map-only chain: validate, decode, clean, cut.  No shuffle anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import text as T

Parser = Callable[[Column], Column]
PARSERS: dict[str, Parser] = {ext: T.decode_utf8 for ext in V.TEXT_EXTENSIONS}


def _has_extension(ext: str) -> Column:
    return F.lower("filename").endswith(ext)


def parsed_text(parsers: dict[str, Parser]) -> Column:
    """The parser registry folded into one CASE over the file name, first match wins."""
    none = F.lit(None).cast("string")
    return reduce(
        lambda rest, item: F.when(_has_extension(item[0]), item[1](F.col("content"))).otherwise(rest),
        reversed(list(parsers.items())),
        none,
    )


def reject_reason(parsers: dict[str, Parser], max_bytes: int = V.DOCUMENT_MAX_BYTES, listed: bool = False) -> Column:
    """Why an upload is refused before parsing, or null.  The order of tests is fixed.
    ``listed``: a column tells the length, so content that is too large need not be there."""
    known = reduce(lambda a, b: a | b, [_has_extension(e) for e in parsers])
    size = F.coalesce(F.col("length") if listed else F.length("content"), F.lit(0))
    return (
        F.when(size == 0, "empty")
        .when(size > max_bytes, "too_large")
        .when(~known, "unsupported_type")
    )


def validate_uploads(
    uploads: DataFrame, parsers: dict[str, Parser] | None = None, max_bytes: int = V.DOCUMENT_MAX_BYTES
) -> DataFrame:
    """Adds content_hash, cleaned text and reject_reason (null when accepted).

    A text cleans to nothing exactly when it holds only whitespace, so acceptance is
    known from its first other character, and tables that carry no text are built
    without cleaning any.
    """
    parsers = parsers or PARSERS
    parsed = parsed_text(parsers)
    blank = ~parsed.rlike(f"[^{T.WS_CHARS}]")
    return uploads.withColumns(
        {
            "content_hash": F.sha2("content", 256),
            "text": T.clean_text(parsed),
            "reject_reason": F.coalesce(reject_reason(parsers, max_bytes, "length" in uploads.columns), F.when(blank, "no_text")),
        }
    )


def _appending(room: int) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, room), F.lit("")))


def chunk_documents(
    docs: DataFrame,
    text: str = "text",
    size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP,
) -> DataFrame:
    """Cut each text into overlapping windows with their character offsets.

    The text is cut once into strides of ``size - overlap`` characters; a window is a
    stride plus the start of the following ones.  That is linear in the text, where a
    substring per window would scan a long text again for each of its windows.
    """
    stride = size - overlap
    if overlap < 0 or stride <= 0:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")
    length = F.length(text)
    strides = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % stride), F.lit(0))
    windows = strides
    for ahead in range(1, math.ceil(size / stride)):
        room = min(stride, size - ahead * stride)
        following = F.slice(strides, ahead + 1, F.greatest(F.size(strides), F.lit(1)))
        windows = F.zip_with(windows, following, _appending(room))
    count = F.when(length <= size, 1).otherwise(1 + F.ceil((length - size) / stride)).cast("int")
    start = F.col("chunk_index") * stride
    others = [c for c in docs.columns if c != text]
    return (
        docs.where(length > 0)
        .select(*others, length.alias("_length"), F.posexplode(F.slice(windows, 1, count)).alias("chunk_index", "chunk_text"))
        .withColumns(
            {
                "char_start": start.cast("int"),
                "char_end": F.least(start + size, F.col("_length")).cast("int"),
            }
        )
        .drop("_length")
    )


@dataclass
class Ingested:
    documents: DataFrame
    concepts: DataFrame
    edges: DataFrame
    chunks: DataFrame
    rejected: DataFrame


def check_uploads(uploads: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """uploads(path, filename, content, created_at, ingest_order[, title, project_id, …])
    to validated rows with ids and cleaned text, without the raw bytes.

    Ids hash the upload path, so equal bytes uploaded twice stay two documents and a
    retried task writes the same rows again.
    """
    for optional in ("title", "project_id"):
        if optional not in uploads.columns:
            uploads = uploads.withColumn(optional, F.lit(None).cast("string"))
    return (
        validate_uploads(uploads, parsers)
        .withColumns(
            {
                "title": F.coalesce(F.nullif("title", F.lit("")), "filename"),
                "document_id": T.stable_id(F.lit("document"), F.col("path")),
                "concept_id": T.stable_id(F.lit("concept"), F.col("path")),
            }
        )
        .drop("content")
    )


def derive_tables(
    checked: DataFrame,
    size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP,
    carry: list[str] | None = None,
) -> Ingested:
    """The tables of checked uploads.  Columns named in ``carry`` go along to the chunks."""
    accepted = checked.where("reject_reason is null")
    documents = accepted.select(
        F.col("document_id").alias("id"),
        "project_id",
        F.lit(None).cast("string").alias("source_id"),
        "title",
        F.col("path").alias("file_path"),
        "content_hash",
        F.lit(True).alias("is_immutable"),
        "created_at",
    )
    concepts = accepted.select(
        F.col("concept_id").alias("id"),
        F.col("title").alias("name"),
        F.concat(F.lit("Concept derived from document '"), "title", F.lit("'")).alias("description"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
    edges = accepted.select(
        T.stable_id(F.lit("edge"), F.col("path")).alias("id"),
        F.lit("concept").alias("source_type"),
        F.col("concept_id").alias("source_id"),
        F.lit("document").alias("target_type"),
        F.col("document_id").alias("target_id"),
        F.lit("derived_from").alias("relationship_type"),
        "created_at",
    )
    kept = accepted.select(
        "document_id", F.col("title").alias("document_title"), "concept_id", "ingest_order", "text", *(carry or [])
    )
    chunks = chunk_documents(kept, "text", size, overlap).withColumns(
        {
            "chunk_id": T.stable_id(F.col("document_id"), F.col("chunk_index")),
            "tokens": T.tokens(F.col("chunk_text")),
        }
    )
    rejected = checked.where("reject_reason is not null").select(
        "path", "filename", "content_hash", "reject_reason", "created_at"
    )
    return Ingested(documents, concepts, edges, chunks, rejected)


def ingest(
    uploads: DataFrame,
    parsers: dict[str, Parser] | None = None,
    size: int = V.CHUNK_SIZE,
    overlap: int = V.CHUNK_OVERLAP,
    carry: list[str] | None = None,
) -> Ingested:
    return derive_tables(check_uploads(uploads, parsers), size, overlap, carry)


def ingest_events(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One DocumentImported per document and one EmbeddingCreated per chunk that has its
    vector; chunks not yet embedded (no such column) count all."""
    if "embedding" in chunks.columns:
        chunks = chunks.where("embedding is not null")
    imported = documents.select(
        F.lit("DocumentImported").alias("name"),
        F.to_json(F.struct(F.col("id").alias("document_id"), "title")).alias("payload"),
    )
    embedded = chunks.select(
        F.lit("EmbeddingCreated").alias("name"),
        F.to_json(F.struct("chunk_id", "document_id")).alias("payload"),
    )
    return imported.unionByName(embedded)
