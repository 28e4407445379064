"""Embedding through a user function, plus store checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .calls import BATCH, answered

Embedder = Callable[[list[str]], list[list[float]]]


def _embed_udf(load: Callable[[], Embedder], batch: int):
    @F.pandas_udf("embedding array<double>, embed_error string")
    def embed_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        embedder = load()

        def run(texts: list[str]) -> list[list[float]]:
            return [[float(x) for x in vector] for vector in embedder(texts)]

        for texts in batches:
            yield pd.DataFrame(list(answered(run, texts.tolist(), batch)), columns=["embedding", "embed_error"])

    return embed_batches


def embed(df: DataFrame, text: str, load: Callable[[], Embedder], batch: int = BATCH) -> DataFrame:
    """Adds embedding and embed_error.  ``load`` runs once per task and returns the
    function that embeds a list of texts, ``batch`` at a time; a failing text gets an error,
    not a failed job, and is found by halving."""
    ship_package(df.sparkSession)
    made = df.withColumn("_made", _embed_udf(load, batch)(F.col(text)))
    return made.select(*df.columns, "_made.embedding", "_made.embed_error")


def embed_new(df: DataFrame, text: str, store: DataFrame, load: Callable[[], Embedder]) -> DataFrame:
    """Embed only texts the store lacks; store(text_hash, embedding).

    Equal texts are embedded once.  The join back has one row per hash on its other
    side, so a text that fills a third of the table is a skewed probe side, which AQE
    splits.
    """
    hashed = df.withColumn("text_hash", F.sha2(F.col(text), 256))
    wanted = hashed.groupBy("text_hash").agg(F.first(text).alias("_text"))
    missing = wanted.join(store.select("text_hash"), "text_hash", "left_anti")
    fresh = embed(missing, "_text", load).select(
        "text_hash", "embedding", "embed_error", F.lit(False).alias("reused")
    )
    known = store.select(
        "text_hash", "embedding", F.lit(None).cast("string").alias("embed_error"), F.lit(True).alias("reused")
    )
    return hashed.join(known.unionByName(fresh), "text_hash", "left")


STORE = "text_hash string, embedding array<double>, batch string"


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The vectors stored below ``path``; a store that is not there yet is begun."""
    spark.createDataFrame([], "text_hash string, embedding array<double>").write.mode("overwrite").parquet(f"{path}/batch=none")
    return spark.read.schema(STORE).parquet(path)


def embed_into(df: DataFrame, text: str, path: str, batch: str, load: Callable[[], Embedder]) -> DataFrame:
    """Embed the texts that the store below ``path`` lacks, append their vectors as a batch
    of its own, and return ``df`` with text_hash and embedding, read from the store.

    A batch run again replaces itself and looks for its texts in the other batches only, so
    a run that was broken off leaves nothing behind.  Failed texts are not stored: they
    have a null vector now and are tried again by a later batch.
    """
    spark = df.sparkSession
    hashed = df.withColumn("text_hash", F.sha2(F.col(text), 256))
    others = open_store(spark, path).where(F.col("batch") != batch)
    wanted = hashed.where(F.col(text).isNotNull()).groupBy("text_hash").agg(F.first(text).alias("_text"))
    fresh = embed(wanted.join(others, "text_hash", "left_anti"), "_text", load)
    fresh.where("embedding is not null").select("text_hash", "embedding").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    known = open_store(spark, path).dropDuplicates(["text_hash"]).drop("batch")
    return hashed.join(known, "text_hash", "left").select(*df.columns, "text_hash", "embedding")


def dimension_report(chunks: DataFrame) -> DataFrame:
    """Vectors per dimension; more than one row means the store is mixed."""
    return chunks.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("vectors"))


def require_one_dimension(chunks: DataFrame) -> None:
    found = [r["dimension"] for r in dimension_report(chunks).limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"store holds vectors of several dimensions: {sorted(found)}")
