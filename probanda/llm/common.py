"""Helpers shared by the operators of this folder.

All operators replace columns of theirs that the input already has (names compare without
case), pass every other column through, and take null text as the empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import ship_package, stored  # noqa: F401

PART_BYTES = 4 << 20  # characters of text handled at once inside a task
BATCH_BYTES = 8 << 20  # of large rows handed to a task at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The input less the columns that an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tasks of the jobs run meanwhile are handed rows of about BATCH_BYTES at once, not all
    of a partition's up to Spark's 64 MB, which JVM and Python each hold."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def parts(batch: pa.RecordBatch, column: str, at_once: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch whose texts stay near ``at_once`` characters together (one long text is one
    slice), with those texts; null becomes empty."""
    at = batch.schema.get_field_index(column)
    start = size = 0
    texts: list[str] = []
    for i in range(batch.num_rows):
        text = batch.column(at)[i].as_py() or ""
        texts.append(text)
        size += len(text) + 64
        if size >= at_once:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(start), texts


def with_columns(df: DataFrame, added: T.StructType, text: str, run: Callable[[list[str]], list[pa.Array]], keep: list[str] | None = None, at_once: int = PART_BYTES) -> DataFrame:
    """Add columns computed from the text column, one Arrow slice after another.  ``keep``
    lists the columns to pass through (all, if absent)."""
    df = without(df, *added.names)
    kept = [c for c in df.columns if keep is None or c in keep]
    schema = T.StructType([df.schema[c] for c in kept] + list(added))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in parts(batch, text, at_once):
                columns = [piece.column(piece.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(columns + run(texts), schema.names)

    need = list(dict.fromkeys([*kept, text]))
    return ship(df).select(*need).mapInArrow(task, schema)


def ship(df: DataFrame) -> DataFrame:
    ship_package(df.sparkSession)
    return df
