"""Chunks laid out for search: groups of near vectors, each with what bounds its scores.

A group holds at most GROUP chunks with the same vector length: their unit vectors, their
tokens, and for whole-group decisions a centre, the widest angle of a member to it and all
tokens of the group (a block-level posting: a query's tokens among them bound its keyword
share).  Groups are formed inside the tasks that read the chunks, so nothing is shuffled
and a vector or document that a third of all chunks share is many groups.  ``store_index``
first lays vectors of one region side by side, for tables that are searched often.

Texts and titles stay in the chunk table and are looked up for the winners of a search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .embed import require_one_dimension

GROUP = 256
BUFFER = 4096  # chunks clustered together inside a task
ROUNDS = 4
PLACES = 64  # groups are dealt to so many places, the key on which many queries meet them
SAMPLE, REGIONS = 4096, 256

IDS = ["chunk_id", "ingest_order", "chunk_index"]
SCHEMA = (
    "place int, grp long, width int, centre binary, angle double, vocabulary array<string>, "
    "vectors binary, tokens array<array<string>>, ids array<struct<chunk_id:string,ingest_order:bigint,chunk_index:int>>"
)


@dataclass(frozen=True)
class ChunkIndex:
    """Groups of the chunks of a table, and the table; where no groups are stored, also the
    rows that they are formed of."""

    groups: DataFrame
    chunks: DataFrame
    rows: DataFrame | None = None


def open_index(spark: SparkSession, path: str, chunks: DataFrame) -> ChunkIndex:
    """The index that ``store_index`` wrote of these chunks."""
    return ChunkIndex(spark.read.schema(SCHEMA).parquet(path), chunks)


def store_index(chunks: DataFrame, path: str) -> ChunkIndex:
    """Write the groups of ``chunks(chunk_id, document_id, ingest_order, chunk_index,
    concept_id, [document_title,] chunk_text, tokens, embedding)``.  A table with vectors of
    several lengths is refused: no query could be compared with all of them."""
    require_one_dimension(chunks.where("embedding is not null"))
    groups = side_by_side(searchable(chunks)).mapInArrow(group_task, SCHEMA)
    groups.write.mode("overwrite").option("parquet.block.size", str(16 << 20)).parquet(path)
    return open_index(chunks.sparkSession, path, chunks)


def indexed(chunks: DataFrame | ChunkIndex) -> ChunkIndex:
    """The index itself; groups of a table that has none are formed as it is read."""
    if isinstance(chunks, ChunkIndex):
        return chunks
    rows = searchable(chunks)
    return ChunkIndex(rows.mapInArrow(group_task, SCHEMA), chunks, rows)


def searchable(chunks: DataFrame, *more: str) -> DataFrame:
    """What is ranked.  Chunks without a vector, or with one that holds non-finite numbers
    (left out by the tasks), are never found."""
    ship_package(chunks.sparkSession)
    tokens = F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")
    return chunks.where("embedding is not null").select(*IDS, *more, tokens, F.col("embedding").cast("array<double>").alias("embedding"))


def side_by_side(rows: DataFrame) -> DataFrame:
    """Sorted by the nearest of REGIONS sampled vectors and a hash, in ranges: a region that
    holds a third of all rows is cut into many."""
    sample = rows.select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(SAMPLE).toArrow()["embedding"]
    known = [unit_rows(v, w) for w, v in by_width(sample.combine_chunks()).items()]
    middles = {m.shape[1]: m[np.linspace(0, len(m) - 1, min(REGIONS, len(m))).astype(int)] for m in known}

    def task(batches):
        for batch in batches:
            region = np.zeros(batch.num_rows, np.int32)
            for width, (where, unit) in widths_of(batch.column("embedding")).items():
                if width in middles:
                    region[where] = (unit @ middles[width].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], [*batch.schema.names, "region"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", region int"
    placed = rows.mapInArrow(task, schema)
    return placed.repartitionByRange("region", F.xxhash64("chunk_id")).sortWithinPartitions("region").drop("region")


def by_width(vectors: pa.ListArray) -> dict[int, pa.ListArray]:
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    return {int(w): vectors.take(pa.array(np.flatnonzero(lengths == w))) for w in np.unique(lengths)}


def unit_rows(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Unit vectors; a zero vector stays zero, one with null or non-finite parts becomes NaN."""
    rows = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(all="ignore"):
        rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return np.divide(rows, norms, out=np.zeros_like(rows), where=norms != 0)


def widths_of(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows of each width."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == width)
        unit = unit_rows(vectors.take(pa.array(where)), width)
        good = np.isfinite(unit).all(axis=1)
        out[width] = where[good], unit[good]
    return out


def cells(unit: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means from a fixed start: the cell of each row."""
    middle = unit[np.linspace(0, len(unit) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        home = (unit @ middle.T).argmax(1)
        order = np.argsort(home, kind="stable")
        used, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(unit[order], first, axis=0)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        middle[used] = np.divide(sums, norms, out=middle[used], where=norms > 1e-9)
    return (unit @ middle.T).argmax(1)


def groups_of(unit: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each group: near vectors together, zero vectors apart."""
    zero = ~unit.any(axis=1)
    rest = np.flatnonzero(~zero)
    home = cells(unit[rest], -(-2 * len(rest) // GROUP)) if len(rest) else np.zeros(0, int)
    for members in [*(rest[home == c] for c in np.unique(home)), np.flatnonzero(zero)]:
        for start in range(0, len(members), GROUP):
            yield members[start : start + GROUP]


def group_task(batches) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part, made = context.partitionId() if context else 0, 0
    held: list[pa.RecordBatch] = []
    rows = 0

    def rest():
        nonlocal made
        table = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in table:
            for width, (where, unit) in widths_of(batch.column("embedding")).items():
                for members in groups_of(unit):
                    yield group_row(batch.take(pa.array(where[members])), unit[members], (part + made) % PLACES, (part << 33) + made, width)
                    made += 1

    for batch in batches:
        for start in range(0, batch.num_rows, BUFFER):
            held.append(batch.slice(start, BUFFER))
            rows += held[-1].num_rows
            if rows >= BUFFER:
                yield from rest()
                held, rows = [], 0
    if held:
        yield from rest()


def group_row(batch: pa.RecordBatch, unit: np.ndarray, place: int, grp: int, width: int) -> pa.RecordBatch:
    centre = unit.sum(0)
    length = np.sqrt((centre * centre).sum())
    centre = centre / length if length > 1e-9 else unit[0]
    angle = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) + 1e-7
    listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    tokens = batch.column("tokens")
    ids = pa.StructArray.from_arrays([batch.column(c).cast(t) for c, t in zip(IDS, (pa.string(), pa.int64(), pa.int32()))], IDS)
    columns = [
        pa.array([place], pa.int32()), pa.array([grp], pa.int64()), pa.array([width], pa.int32()), pa.array([centre.tobytes()]), pa.array([angle]),
        listed(pc.unique(pc.list_flatten(tokens))), pa.array([unit.tobytes()]), listed(tokens), listed(ids),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in SCHEMA.split(", ")])
