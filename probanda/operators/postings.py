"""Keyword search over a stored inverted index, with a maximum-score cut.

The index has three tables: ``dictionary`` (token, df), ``lists`` (token, part, ids: runs of
about LIST texts, so a token of a third of all texts is many lists) and ``forward`` (id,
tokens).  A text scores the share of the query's tokens that it holds.

Tokens are asked in order of rarity.  A text whose rarest shared token is the r-th of a
query's P known tokens shares P - r + 1 at most.  So once some k texts are known to score a
floor, only lists of tokens that can still reach it are read, and of the texts in them only
those are scored that can: the commonest tokens are never looked up.  The answer is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import keyword_score

LIST = 4096
SEEDS = 3  # rarest tokens whose first lists give the floor


@dataclass(frozen=True)
class Postings:
    dictionary: DataFrame
    lists: DataFrame
    forward: DataFrame


def open_postings(spark: SparkSession, path: str) -> Postings:
    return Postings(*(spark.read.parquet(f"{path}/{t}") for t in ("dictionary", "lists", "forward")))


def store_postings(texts: DataFrame, path: str) -> Postings:
    """Write the index of texts(id, tokens), tokens distinct.  Null and empty token lists
    are found by no query; a null id is left out."""
    spark = texts.sparkSession
    texts.where("id is not null").select("id", "tokens").write.mode("overwrite").parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    each = forward.select("id", F.explode("tokens").alias("token"))
    each.groupBy("token").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/dictionary")
    dictionary = spark.read.parquet(f"{path}/dictionary")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / LIST)).cast("int").alias("part")
    lists = each.join(dictionary, "token").groupBy("token", part).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # tokens lie together, so a read of few of them skips most row groups
    lists.repartitionByRange("token", "part").sortWithinPartitions("token", "part").write.mode("overwrite").parquet(f"{path}/lists")
    return open_postings(spark, path)


def ranked_tokens(queries: DataFrame, index: Postings) -> DataFrame:
    """query_id, token, r (rarest first), known (P), asked (the query's tokens)."""
    asked = F.array_distinct("tokens")
    each = queries.select("query_id", F.size(asked).alias("asked"), F.explode(asked).alias("token")).join(index.dictionary, "token")
    own = Window.partitionBy("query_id")
    return each.withColumns({"r": F.row_number().over(own.orderBy("df", "token")), "known": F.count("*").over(own)})


def scored(pairs: DataFrame, queries: DataFrame, index: Postings) -> DataFrame:
    """Exact scores of (query_id, id) pairs."""
    wanted = pairs.join(queries.select("query_id", F.array_distinct("tokens").alias("query_tokens")), "query_id")
    both = wanted.join(index.forward.withColumnRenamed("tokens", "text_tokens"), "id")
    return both.select("query_id", "id", keyword_score(F.col("query_tokens"), F.col("text_tokens")).alias("score"))


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def floors(tokens: DataFrame, queries: DataFrame, index: Postings, k: int) -> DataFrame:
    """query_id, floor: what the k-th of some texts scores; 0 for queries with fewer."""
    seeds = tokens.where(F.col("r") <= SEEDS).join(index.lists.where("part = 0"), "token")
    pairs = seeds.select("query_id", F.explode("ids").alias("id")).distinct()
    kth = best(scored(pairs, queries, index), k).where(F.col("rank") == k)
    return kth.select("query_id", F.col("score").alias("floor"))


def essential(tokens: DataFrame, floor: DataFrame) -> DataFrame:
    """The tokens whose lists can hold a text that reaches the floor, with the tokens of the
    query that are not among them (``rest``)."""
    can = (F.col("known") - F.col("r") + 1) / F.col("asked") >= F.col("floor")
    kept = tokens.join(floor, "query_id", "left").na.fill(0.0, ["floor"]).where(can)
    return kept.withColumn("rest", F.col("known") - F.count("*").over(Window.partitionBy("query_id")))


def keyword_top_k(queries: DataFrame, index: Postings, k: int) -> DataFrame:
    """query_id, id, score, rank of the k best texts of queries(query_id, tokens): those
    that share a token, by score, then id.  query_id is unique."""
    tokens = ranked_tokens(queries, index)
    lists = essential(tokens, floors(tokens, queries, index, k)).join(index.lists, "token")
    met = lists.select("query_id", "asked", "floor", "rest", F.explode("ids").alias("id"))
    pairs = met.groupBy("query_id", "id").agg(F.count("*").alias("shared"), F.first("asked").alias("asked"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    able = pairs.where((F.col("shared") + F.col("rest")) / F.col("asked") >= F.col("floor"))
    return best(scored(able.select("query_id", "id"), queries, index), k).select("query_id", "id", "score", "rank")
