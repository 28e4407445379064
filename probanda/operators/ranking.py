"""Exact best chunks of many queries over a chunk index.

Queries stay a table: tasks pack them into block rows of at most BLOCK_QUERIES.  Blocks that
together are smaller than BROADCAST_BYTES are broadcast to the tasks that read the chunks;
each forms its groups (or reads stored ones), some at a time, and asks them all queries, so a
chunk is handed over once however many blocks there are.  More queries meet the groups in a
join by place, to which every block is sent once.  For each query and
group the score is bounded from above (the angle to the group's centre less its widest
member; the query's tokens among the group's).  A task asks each query's most promising
group first, and passes over every group whose bound lies below the query's top_k-th score
so far: exactly, ties included.

Queries for one document meet only its chunks, by a join on document_id (without a shuffle
of chunks where their table is bucketed by it).

Ids and scores alone are shuffled to the merge; texts are joined to the winners, which are
broadcast where they are few, so that no text is shuffled.  Scores
decide as they are (rounded at the twelfth decimal, against the order of floating-point
sums) and are rounded to six where they are published.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window, functions as F

from .. import fixed_values as V
from ..functions.text import keyword_score
from ..session import shared_dir
from .chunk_index import IDS, PLACES, ChunkIndex, group_task, indexed, searchable, unit_rows

BLOCK_QUERIES = 512
BROADCAST_BYTES = 32 << 20
WINNER_BYTES = 256  # of one ranked row, without its text
MERGE_SLOTS = 64
TOGETHER = 32  # groups that a task compares with the queries at once
HELD = 100_000  # scored rows that a task holds back to drop those that better ones overtake

SCORED = (
    "query_id string, chunk_id string, ingest_order long, chunk_index int, "
    "score double, semantic_score double, keyword_score double, top_k int"
)
SHOWN = ["document_id", "ingest_order", "chunk_index", "concept_id", "document_title", "chunk_text"]
_NAMES = [f.split(" ")[0] for f in SCORED.split(", ")]
_SLACK = 1e-9  # bounds are sums of rounded numbers too


def decided(score):
    """The score that decides: equal vectors give equal scores wherever they lie."""
    return np.floor(score * 1e12 + 0.5) / 1e12


@dataclass
class QueryBlock:
    """One block of queries, ready for matrix products.  ``words`` and ``owners``: each token
    of each query once, by its place in the vocabulary; a matrix of them all would grow with
    queries times their tokens, and a task holds every block."""

    ids: pa.Array
    unit: np.ndarray
    vocabulary: pa.Array
    words: np.ndarray
    owners: np.ndarray
    n_tokens: np.ndarray
    top_k: np.ndarray
    min_score: np.ndarray

    @classmethod
    def of(cls, rows: pa.StructArray) -> "QueryBlock":
        vectors, tokens = rows.field("embedding"), rows.field("tokens")
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        if len(np.unique(lengths)) > 1:
            raise ValueError("embedding dimension mismatch among queries")
        matrix = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        words = pc.list_flatten(tokens)
        vocabulary = pc.unique(words)
        places = pc.index_in(words, value_set=vocabulary).to_numpy().astype(np.int64) * max(1, len(rows))
        each = np.unique(places + pc.list_parent_indices(tokens).to_numpy())
        return cls(
            rows.field("query_id"), np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0), vocabulary, *np.divmod(each, max(1, len(rows))),
            np.maximum(1, pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.float64),
            rows.field("top_k").to_numpy(zero_copy_only=False), rows.field("min_score").to_numpy(zero_copy_only=False),
        )


@dataclass
class Group:
    """One group of the index."""

    centre: np.ndarray
    angle: float
    vocabulary: pa.Array
    vectors: np.ndarray
    tokens: pa.ListArray
    ids: pa.StructArray

    @cached_property
    def coded(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The group's distinct tokens; of each token of a member its place among them and the
        member.  Worked out once, however many blocks ask."""
        coded = pc.list_flatten(self.tokens).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), pc.list_parent_indices(self.tokens).to_numpy()

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> "Group":
        get = lambda name: batch.column(name)[i]
        width = get("width").as_py()
        return cls(
            np.frombuffer(get("centre").as_py()), get("angle").as_py(), get("vocabulary").values,
            np.frombuffer(get("vectors").as_py()).reshape(-1, width), get("tokens").values, get("ids").values,
        )


@dataclass
class Weights:
    semantic: float = V.SEMANTIC_WEIGHT
    keyword: float = V.KEYWORD_WEIGHT


def bound(block: QueryBlock, group: Group, weights: Weights) -> np.ndarray:
    """No member of the group scores higher with the query."""
    if block.unit.shape[1] != group.vectors.shape[1]:
        raise ValueError("embedding dimension mismatch")
    away = np.arccos(np.clip(block.unit @ group.centre, -1, 1))
    score = weights.semantic * np.cos(np.maximum(0, away - group.angle))
    if weights.keyword and len(block.vocabulary):
        there = pc.is_in(block.vocabulary, value_set=group.vocabulary).to_numpy(zero_copy_only=False)
        score = score + weights.keyword * np.bincount(block.owners[there[block.words]], minlength=len(block.ids)) / block.n_tokens
    return score + _SLACK


def shared_tokens(block: QueryBlock, group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens that queries of the block and members of the group have in common: which
    query has which (token × query), and which member (member × token)."""
    words, codes, members = group.coded
    found = pc.index_in(words, value_set=block.vocabulary)
    used = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    local = np.full(len(words), -1)
    local[used] = np.arange(len(used))
    known = local[codes] >= 0
    present = np.zeros((len(group.vectors), len(used)), np.float32)
    present[members[known], local[codes[known]]] = 1
    place = np.full(len(block.vocabulary), -1)
    place[found.take(pa.array(used)).to_numpy()] = np.arange(len(used))
    at = place[block.words]
    wanted = np.zeros((len(used), len(block.ids)), np.float32)
    wanted[at[at >= 0], block.owners[at >= 0]] = 1
    return wanted, present


def scores(block: QueryBlock, group: Group, shared: tuple | None, asked: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deciding, semantic and keyword scores: query × member."""
    semantic = block.unit[asked] @ group.vectors.T
    keyword = np.zeros_like(semantic)
    if shared is not None:
        wanted, present = shared
        keyword = (wanted[:, asked].T @ present.T) / block.n_tokens[asked][:, None]
    return decided(weights.semantic * semantic + weights.keyword * keyword), semantic, keyword


class Best:
    """The best scores of one block's queries so far, in one task."""

    def __init__(self, block: QueryBlock):
        self.scores = np.full((len(block.ids), int(block.top_k.max(initial=1))), -np.inf)

    def add(self, asked: np.ndarray, found: np.ndarray) -> None:
        k = self.scores.shape[1]
        both = np.concatenate([self.scores[asked], found], axis=1)
        self.scores[asked] = -np.sort(-both, axis=1)[:, :k] if both.shape[1] <= 64 else -np.sort(np.partition(-both, k - 1, axis=1)[:, :k], axis=1)

    def floor(self, block: QueryBlock) -> np.ndarray:
        return np.maximum(block.min_score, self.scores[np.arange(len(block.ids)), block.top_k - 1])


class Search:
    """What one task has found."""

    def __init__(self, weights: Weights, tally: Counter | None = None):
        self.weights, self.tally = weights, Counter() if tally is None else tally
        self.best: dict[int, Best] = {}
        self.held: list[tuple[int, QueryBlock, np.ndarray, pa.Table]] = []

    def meet(self, number: int, block: QueryBlock, groups: list[Group]) -> None:
        """A block of queries and some groups: most promising pairs first."""
        best = self.best.setdefault(number, Best(block))
        bounds = np.stack([bound(block, g, self.weights) for g in groups], axis=1)
        first = bounds.argmax(axis=1)
        self.tally["pairs"] += bounds.size
        shared: dict[int, tuple | None] = {}
        for turn in (True, False):
            for g, group in enumerate(groups):
                open_ = (first == g) == turn
                asked = np.flatnonzero(open_ & (bounds[:, g] >= best.floor(block)))
                if len(asked):
                    self.tally["scored"] += len(asked)
                    if g not in shared:
                        shared[g] = shared_tokens(block, group) if self.weights.keyword and len(block.vocabulary) else None
                    self.score(number, block, best, group, shared[g], asked)

    def score(self, number: int, block: QueryBlock, best: Best, group: Group, shared: tuple | None, asked: np.ndarray) -> None:
        found, semantic, keyword = scores(block, group, shared, asked, self.weights)
        best.add(asked, found)
        q, m = np.nonzero(found >= best.floor(block)[asked][:, None])
        if len(q):
            each = [
                block.ids.take(pa.array(asked[q])), *[group.ids.field(c).take(pa.array(m)) for c in IDS],
                pa.array(found[q, m]), pa.array(semantic[q, m]), pa.array(keyword[q, m].astype(np.float64)), pa.array(block.top_k[asked[q]].astype(np.int32)),
            ]
            self.held.append((number, block, asked[q], pa.table(each, _NAMES)))

    def emit(self) -> Iterator[pa.RecordBatch]:
        """Rows that no better ones have overtaken since."""
        for number, block, q, rows in self.held:
            kept = rows["score"].to_numpy() >= self.best[number].floor(block)[q]
            yield from rows.filter(pa.array(kept)).to_batches()
        self.held = []


def search_batches(batches: Iterator[pa.RecordBatch], weights: Weights, tally: Counter | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (block, queries, group columns) of the join, batch by batch."""
    search = Search(weights, tally)
    for batch in batches:
        numbers, groups = batch.column("block").to_numpy(), [Group.of(batch, i) for i in range(batch.num_rows)]
        for number in np.unique(numbers).tolist():
            at = np.flatnonzero(numbers == number).tolist()
            search.meet(number, QueryBlock.of(batch.column("queries")[at[0]].values), [groups[i] for i in at])
        if sum(len(h[2]) for h in search.held) >= HELD:
            yield from search.emit()
    yield from search.emit()


def search_groups(groups: Iterator[pa.RecordBatch], blocks: pa.Table, weights: Weights, tally: Counter | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the index, batch by batch, with every block of queries."""
    search = Search(weights, tally)
    numbers, listed = blocks["block"].to_pylist(), blocks["queries"].combine_chunks()
    known = [(number, QueryBlock.of(listed[i].values)) for i, number in enumerate(numbers)]
    for some in batched((Group.of(batch, i) for batch in groups for i in range(batch.num_rows)), TOGETHER):
        for number, block in known:
            search.meet(number, block, list(some))
            if sum(len(h[2]) for h in search.held) >= HELD:
                yield from search.emit()
    yield from search.emit()


BLOCK = "block long, queries array<struct<query_id:string,embedding:array<double>,tokens:array<string>,top_k:int,min_score:double>>"


def query_blocks(queries: DataFrame, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The query table in rows of at most ``block_queries`` queries.  Equal rows are one
    query."""
    names = ["query_id", "embedding", "tokens", "top_k", "min_score"]

    def pack(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, block_queries):
                rows = batch.slice(start, block_queries)
                listed = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), pa.StructArray.from_arrays(rows.columns, names))
                yield pa.RecordBatch.from_arrays([pa.array([(part << 33) + made]), listed], ["block", "queries"])
                made += 1

    rows = queries.select(*names).distinct().sortWithinPartitions("query_id", "tokens", "embedding")
    return rows.mapInArrow(pack, BLOCK)


def met(blocks: DataFrame, index: ChunkIndex) -> DataFrame:
    """Every block beside every group."""
    spark = blocks.sparkSession
    path, seen = shared_dir(spark, "query-blocks"), Observation()
    words = F.aggregate("queries", F.lit(0).cast("long"), lambda n, q: n + 128 + 8 * F.size(q["embedding"]) + 32 * F.size(q["tokens"]))
    blocks.observe(seen, F.coalesce(F.sum(words), F.lit(0)).alias("bytes")).write.parquet(path)
    blocks, size = spark.read.schema(BLOCK).parquet(path), seen.get["bytes"]
    if size <= BROADCAST_BYTES:
        return index.groups.withColumn("all", F.lit(0)).join(F.broadcast(blocks.withColumn("all", F.lit(0))), "all")
    places = F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))
    return index.groups.join(blocks.withColumn("place", places).hint("merge"), "place")


def search_all(queries: DataFrame, index: ChunkIndex, weights: Weights, block_queries: int, few: bool) -> DataFrame:
    """``few``: the queries are small enough to be sent to every task."""
    blocks = query_blocks(queries, block_queries)
    if not few:
        return met(blocks, index).mapInArrow(lambda batches: search_batches(batches, weights), SCORED)
    asked = queries.sparkSession.sparkContext.broadcast(blocks.toArrow())
    if index.rows is None:
        return index.groups.mapInArrow(lambda batches: search_groups(batches, asked.value, weights), SCORED)
    return index.rows.mapInArrow(lambda batches: search_groups(group_task(batches), asked.value, weights), SCORED)


def search_documents(queries: DataFrame, chunks: DataFrame, weights: Weights) -> DataFrame:
    """Queries that name a document, with its chunks alone."""
    asked = queries.select("query_id", "document_id", "top_k", "min_score", F.col("tokens").alias("query_tokens"), F.col("embedding").alias("query_vector"))
    rows = searchable(chunks, "document_id")
    pairs = rows.join(asked, "document_id")
    semantic = pairs.mapInArrow(cosines, "query_id string, chunk_id string, ingest_order long, chunk_index int, top_k int, min_score double, semantic_score double, query_tokens array<string>, tokens array<string>")
    keyword = keyword_score(F.col("query_tokens"), F.col("tokens")) if weights.keyword else F.lit(0.0)
    score = F.floor((weights.semantic * F.col("semantic_score") + weights.keyword * F.col("keyword_score")) * 1e12 + 0.5) / 1e12
    return semantic.withColumn("keyword_score", keyword).withColumn("score", score).where("score >= min_score").select(*_NAMES)


def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row by row the cosine of the query's vector with the chunk's."""
    names = ["query_id", *IDS, "top_k", "min_score"]
    for batch in batches:
        a, b = batch.column("query_vector"), batch.column("embedding")
        width = pc.list_value_length(a).to_numpy(zero_copy_only=False)
        if (pc.list_value_length(b).to_numpy(zero_copy_only=False) != width).any():
            raise ValueError("embedding dimension mismatch")
        semantic = np.zeros(batch.num_rows)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            semantic[rows] = (unit_rows(a.take(pa.array(rows)), w) * unit_rows(b.take(pa.array(rows)), w)).sum(axis=1)
        out = [batch.column(n) for n in names] + [pa.array(semantic), batch.column("query_tokens"), batch.column("tokens")]
        yield pa.RecordBatch.from_arrays(out, [*names, "semantic_score", "query_tokens", "tokens"])


def rank_chunks(
    queries: DataFrame,
    chunks: DataFrame | ChunkIndex,
    semantic_weight: float = V.SEMANTIC_WEIGHT,
    keyword_weight: float = V.KEYWORD_WEIGHT,
    block_queries: int = BLOCK_QUERIES,
    filtered: bool = True,
) -> DataFrame:
    """queries(query_id, embedding, tokens, document_id, top_k, min_score) × chunks (a table
    or its stored index); ``filtered``: some queries may name a document."""
    index, weights = indexed(chunks), Weights(semantic_weight, keyword_weight)
    queries = queries.where("embedding is not null").select("query_id", "embedding", "tokens", "document_id", "top_k", "min_score")
    queries, size, wanted = stored_queries(queries)
    few, few_winners = size <= BROADCAST_BYTES, wanted * WINNER_BYTES <= BROADCAST_BYTES
    if not filtered:
        return winners(search_all(queries, index, weights, block_queries, few), index, few_winners)
    found = search_all(queries.where("document_id is null"), index, weights, block_queries, few)
    named = search_documents(queries.where("document_id is not null"), index.chunks, weights)
    return winners(found.unionByName(named), index, few_winners)


def stored_queries(queries: DataFrame) -> tuple[DataFrame, int, int]:
    """The queries written and read again, their size and how many chunks they ask for."""
    spark, path = queries.sparkSession, shared_dir(queries.sparkSession, "queries")
    queries.write.parquet(path)
    queries = spark.read.schema(queries.schema).parquet(path)
    size = F.sum(128 + 8 * F.size("embedding").cast("long") + 32 * F.size("tokens"))
    return queries, *queries.agg(F.coalesce(size, F.lit(0)), F.coalesce(F.sum("top_k"), F.lit(0))).first()


def winners(scored: DataFrame, index: ChunkIndex, few: bool = False) -> DataFrame:
    """Rank the tasks' rows of each query, first within slots by chunk, then over what the
    slots keep: at most MERGE_SLOTS · top_k rows meet in one task, however many tasks
    searched.  Texts and titles come last, to the winners, which are broadcast if ``few``."""
    best_first = [F.col("score").desc(), "ingest_order", "chunk_index", "chunk_id"]
    slot = F.pmod(F.xxhash64("chunk_id"), F.lit(MERGE_SLOTS))
    rank = F.row_number()
    in_slot = rank.over(Window.partitionBy("query_id", "_slot").orderBy(*best_first))
    kept = scored.withColumn("_slot", slot).withColumn("rank", in_slot).where("rank <= top_k").drop("_slot", "rank")
    overall = rank.over(Window.partitionBy("query_id").orderBy(*best_first))
    ranked = kept.withColumn("rank", overall).where("rank <= top_k").select("query_id", "rank", "chunk_id", "score", "semantic_score", "keyword_score", "top_k")
    shown = index.chunks if "document_title" in index.chunks.columns else index.chunks.withColumn("document_title", F.lit(None).cast("string"))
    return shown.select("chunk_id", *SHOWN).join(F.broadcast(ranked) if few else ranked, "chunk_id")
