"""Documents in, training tokens out: quality, near-duplicates, decontamination, personal
data, token ids.  Each stage works on all that the one before kept, written as Parquet and
read again; all but the last return the columns of documents.

Cases: see the operators.  Null ids and texts, repeated rows and extra columns pass every
stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from probanda.llm import bpe, decontaminate, pii, quality, simhash
from probanda.llm.common import stored, table
from probanda.llm.queries import VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return pii.mask(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of every text, and whether they decode to that text; columns named
    ids, decoded or round_trip give way."""
    both = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    given = F.coalesce("text", F.lit(""))
    return both.withColumn("round_trip", F.col("decoded") == given).drop("decoded")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("token_ids", encode_tokens),
]

#: The classifier, fingerprints and merges cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
