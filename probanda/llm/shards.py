"""Sharding by histogram sort: equal bytes per shard, one exchange.

Every row has a 62-bit key: the hash of its text above, then the hash of its id, below a
hash of its place in the input, so equal texts lie together and a group of copies of any
size, rows of one id included, can still be cut.  Rows and keys are written once, so that
tasks run again find the same places.  Splitters between
the shards are found by counting: each round lays a grid of probes over the key ranges
that still hold a wanted splitter, counts the exact bytes below every probe across all
partitions, and keeps the grid cell around each target, until a cell holds less than the
tolerance or is one key wide.  Then the rows are dealt once, by shard and salt, and get
their slots from the counts of the salts before theirs.  A salt is a hash of text and id;
one that holds far more rows than meant is cut further by their places.

Cases: null and empty texts are one byte, as the size counts one more than the text; rows
of one id and one text, and null ids, are told apart by their places (which of the equal
rows of a cut group lies in which shard hangs on them); an empty table gives an empty table; columns named like the outputs are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ship, stored, text_or_empty, without

SHARDS = 16
LAW = "bytes"
TOLERANCE = 0.001  # of a shard's bytes, for each splitter
PROBES = 2048  # of one round, over all ranges still open
TEXT_BITS, ID_BITS, ROW_BITS = 27, 20, 15
SALT_ROWS = 20_000  # rows meant for one salt of a shard
HEAVY = 4  # times as many, and a salt is cut
TOP = 1 << (TEXT_BITS + ID_BITS + ROW_BITS)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __size (bytes of the text and one more) and __key."""
    content = text_or_empty(text)
    high = F.shiftrightunsigned(F.xxhash64(content), 64 - TEXT_BITS)
    middle = F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 64 - ID_BITS)
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - ROW_BITS)
    return ship(docs).withColumns({
        "__size": F.octet_length(content).cast("long") + 1,
        "__key": F.shiftleft(F.shiftleft(high, ID_BITS).bitwiseOR(middle), ROW_BITS).bitwiseOR(place),
    })


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """shards - 1 ascending keys: shard i has the keys from splitter i - 1 up to below
    splitter i.  ``keys`` has __key and __size."""
    total = keys.agg(F.sum("__size")).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    allowed = max(1, total / shards * tolerance)
    # ranges (low, high, bytes below low, bytes inside) that hold targets
    open_ranges = {(0, TOP, 0, total): targets}
    found: dict[int, int] = {}
    while open_ranges:
        per_range = max(2, PROBES // len(open_ranges))
        grid = [(low, high, max(1, -(-(high - low) // per_range))) for low, high, _, _ in open_ranges]
        counted = {(r["range"], r["cell"]): r["bytes"] for r in counts(keys, grid).collect()}
        narrower: dict = {}
        for i, ((low, high, below, _), wanted) in enumerate(open_ranges.items()):
            step, at, todo = grid[i][2], below, list(wanted)
            for cell in range(-(-(high - low) // step)):
                inside = counted.get((i, cell), 0)
                start, end = low + cell * step, min(high, low + (cell + 1) * step)
                here = [t for t in todo if at <= t < at + inside]
                todo = [t for t in todo if t not in here]
                if here and (inside <= allowed or end - start == 1):
                    found |= {t: start if t - at <= at + inside - t else end for t in here}
                elif here:
                    narrower[(start, end, at, inside)] = here
                at += inside
            found |= {t: high for t in todo}
        open_ranges = narrower
    return [found[t] for t in targets]


def counts(keys: DataFrame, grid: list[tuple[int, int, int]]) -> DataFrame:
    """Exact bytes in every cell of every range: at most PROBES rows or so."""
    where, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    key = F.col("__key")
    for i, (low, high, step) in reversed(list(enumerate(grid))):
        inside = (key >= low) & (key <= high - 1)
        where = F.when(inside, i).otherwise(where)
        cell = F.when(inside, F.expr(f"(__key - {low}L) div {step}L") if step > 1 else key - low).otherwise(cell)
    placed = keys.select(where.alias("range"), cell.alias("cell"), "__size").where("range IS NOT NULL")
    return placed.groupBy("range", "cell").agg(F.sum("__size").alias("bytes"))


def shard_of(bounds: list[int]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("__key"))) if bounds else F.lit(0)


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot (gapless from 0 in each shard) and
    grown_shard (null under this law).  ``carry``: columns kept (all, if absent)."""
    outputs = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = without(docs, *outputs)
    kept = [c for c in docs.columns if carry is None or c in carry]
    rows = keyed(docs, text).withColumn("text_crc32", F.crc32(F.encode(text_or_empty(text), "UTF-8")))
    rows = stored(rows.select(*kept, F.col("__size").alias("size"), "text_crc32", "__key"), "shard-rows")
    keys = rows.select("__key", F.col("size").alias("__size"))
    bounds = splitters(keys, shards)
    # salts spread the numbering of one shard over many tasks; all counts go by the same law
    salts = max(1, math.ceil(keys.count() / shards / SALT_ROWS))
    salt = F.pmod(F.xxhash64(F.shiftrightunsigned("__key", ROW_BITS)), F.lit(salts))
    placed = {"shard": shard_of(bounds), "__salt": salt}
    sizes = keys.withColumns(placed).groupBy("shard", "__salt").count()
    cuts = F.when(F.col("count") > HEAVY * SALT_ROWS, F.ceil(F.col("count") / SALT_ROWS)).otherwise(1)
    sizes = sizes.select("shard", "__salt", cuts.alias("__cuts"))
    cut = F.pmod(F.col("__key"), F.col("__cuts"))
    numbered = keys.withColumns(placed).join(sizes, ["shard", "__salt"]).groupBy("shard", "__salt", cut.alias("__cut")).count()
    before = F.sum("count").over(_window("shard", ["__salt", "__cut"]).rowsBetween(Window.unboundedPreceding, -1))
    starts = numbered.select("shard", "__salt", "__cut", F.coalesce(before, F.lit(0)).cast("long").alias("__start"))
    dealt = rows.withColumns(placed).join(sizes, ["shard", "__salt"]).withColumn("__cut", cut).join(starts, ["shard", "__salt", "__cut"])
    number = F.row_number().over(_window(["shard", "__salt", "__cut"], "__key"))
    return dealt.select(
        *kept, "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("__start") + number - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _window(by, order):
    return Window.partitionBy(by).orderBy(order)


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Shards as folders shard=N, rows in slot order."""
    placed = assign(docs, shards)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    placed = assign(docs.select("doc_id", "text"), carry=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
