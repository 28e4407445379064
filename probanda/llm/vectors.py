"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Equal vectors are one entry with a count.  The centres are fitted on at most SAMPLE
vectors and spread apart; every vector has a home cell.  Runs of neighbouring cells with
about BLOCK vectors are one place.  A vector whose home is another cell than this vector's
lies beyond the plane between the two centres, and a linked one no further than the angle
of THRESHOLD: a vector visits every place of a lower number with a cell whose plane is
within that angle, so each linked pair is met once, whatever the cells are.  A place's
visitors and members are cut into blocks of about BLOCK; each pair of blocks is one matrix
product in one task, so a place of any size is many tasks.  A product leaves, for each
vector, its number of links and the smallest vector of its part of the graph, never pairs.

Exactly the pairs with a cosine of THRESHOLD or more are linked.  Where vectors are
scattered, so that nearly every plane is near, every pair is compared.

Cases: null vectors, empty ones, zero ones and such with null or non-finite components link
with nothing and are their own component; vectors of different lengths do not link; rows
with a repeated id are vectors of their own; a null id is the smallest of a component only
where all are null; an empty table gives an empty table; columns named like the outputs
are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, stored, without
from .graph import components

THRESHOLD = 0.9
SAMPLE = 16_384  # vectors the centres are fitted on: the least by hash
CELL = 512  # vectors meant for one cell
MOST_CELLS = 4096  # bounds the broadcast centres
APART = 0.8  # centres closer than this cosine are one
REACH = (1 - THRESHOLD**2) ** 0.5 + 1e-9  # sine of the widest angle of a link
BLOCK = 4096
ROUNDS = 8


def usable(vector: str):
    """Native test: finite, not null, not zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from a fixed start; centres that lie close together become one."""
    if not len(sample):
        return np.zeros((0, 0))
    rng = np.random.default_rng(11)
    found = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        home = np.concatenate([(sample[i : i + 2048] @ found.T).argmax(1) for i in range(0, len(sample), 2048)])
        order = np.argsort(home, kind="stable")
        used, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        good = np.abs(sums).max(axis=1) > 1e-9
        found[used[good]] = unit(sums[good])
    kept: list[int] = []
    close = found @ found.T >= APART
    for i in range(len(found)):
        if not close[i, kept].any():
            kept.append(i)
    return found[kept]


def placed(known: DataFrame, width: int, middle: np.ndarray) -> DataFrame:
    """Adds home and visits (places).  Vectors of another length than ``width`` share one
    place per length."""
    spark = known.sparkSession
    shared = spark.sparkContext.broadcast(middle)

    def homes(batches):
        for part, same, cosine in cosines(batches, width, shared.value):
            home = np.negative(part.column(3).to_numpy().astype(np.int64))
            if cosine is not None:
                home[same] = cosine.argmax(1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(home, pa.int32())], ["u", "n", "width", "v", "cell"])

    rows = stored(known.mapInArrow(homes, "u long, n long, width int, v binary, cell int"), "cell-homes")
    members = {r["cell"]: r["count"] for r in rows.where("cell >= 0").groupBy("cell").count().collect()}  # MOST_CELLS at most
    place = places(middle, members)
    # least sine of the angle to the plane, by home: cosines' difference over the centres' distance
    apart = np.sqrt(np.maximum(0, 2 - 2 * middle @ middle.T)) * REACH
    facts = spark.sparkContext.broadcast((middle, place, apart))

    def visits(batches):
        points, place, apart = facts.value
        order = np.argsort(place, kind="stable")
        firsts = np.searchsorted(place[order], np.arange(place.max() + 1)) if len(place) else None
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                cells = part.column(4).to_numpy()
                home, calls = cells.astype(np.int64), [[] for _ in cells]
                same = np.flatnonzero(cells >= 0)
                if len(same):
                    cosine = unpacked(part.column(3), same, width) @ points.T
                    own = cells[same]
                    near = cosine[np.arange(len(own)), own][:, None] - cosine <= apart[own]
                    near = np.logical_or.reduceat(near[:, order], firsts, axis=1)
                    home[same] = place[own]
                    near &= np.arange(near.shape[1]) < home[same][:, None]
                    for i, row in zip(same.tolist(), near):
                        calls[i] = np.flatnonzero(row).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(home, pa.int32()), pa.array(calls, pa.list_(pa.int32()))], ["u", "n", "v", "home", "visits"]
                )

    return rows.mapInArrow(visits, "u long, n long, v binary, home int, visits array<int>")


def unpacked(blobs: pa.Array, which: np.ndarray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.take(pa.array(which)).to_pylist())).reshape(-1, width)


def cosines(batches, width: int, points: np.ndarray):
    """Slices, which of their vectors have the width, and those vectors' cosines to the centres."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            same = np.flatnonzero(part.column(3).to_numpy() == width)
            yield part, same, unpacked(part.column(4), same, width) @ points.T if len(same) and len(points) else None


def places(middle: np.ndarray, members: dict[int, int]) -> np.ndarray:
    """The place of every cell: from the first on, the nearest cell left comes next, and
    goes to the same place while that has fewer than BLOCK members with it."""
    place, left = np.zeros(len(middle), np.int64), np.ones(len(middle), bool)
    at = number = load = 0
    for step in range(len(middle)):
        left[at] = False
        own = members.get(at, 0)
        if step and load + own > BLOCK:
            number, load = number + 1, 0
        place[at] = number
        load += own
        at = int(np.where(left, middle @ middle[at], -np.inf).argmax())
    return place


def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One block of callers (members and visitors) against one block of members of a place."""
    place = key[0]
    side = group["member"].to_numpy()
    left, right = group[~side], group[side]
    out: list[pd.DataFrame] = []
    if len(left) and len(right):
        b = np.frombuffer(b"".join(right["v"])).reshape(len(right), -1)
        b_ids, b_n = right["u"].to_numpy(), right["n"].to_numpy()
        for start in range(0, len(left), 256):
            part = left.iloc[start : start + 256]
            a = np.frombuffer(b"".join(part["v"])).reshape(len(part), -1)
            a_ids, a_n, homes = part["u"].to_numpy(), part["n"].to_numpy(), part["home"].to_numpy()
            i, j = np.nonzero(a @ b.T >= THRESHOLD)
            other = a_ids[i] != b_ids[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            # visitors are not called at by members; members of one place are each other's callers
            once = homes[i] != place
            links = np.concatenate([np.bincount(i, b_n[j], len(a)), np.bincount(j[once], a_n[i[once]], len(b))]).astype(np.int64)
            ids = np.concatenate([a_ids, b_ids])
            seen = np.unique(np.concatenate([i, len(a) + j]))
            root = local_roots(ids, i, len(a) + j)
            out.append(pd.DataFrame({"u": ids[seen], "links": links[seen], "root": root[seen]}))
    return pd.concat(out) if out else pd.DataFrame({"u": [], "links": [], "root": []}).astype("int64")


def local_roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest id that each place reaches over the links (i, j) of this product."""
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, new[i])
        if (new == root).all():
            return root
        root = new


def linked_entries(known: DataFrame) -> DataFrame:
    """u, links (by row count) and root of the entries that link with another entry."""
    total = known.count()
    widths = known.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 0
    sample = known.where(F.col("width") == width).orderBy(F.xxhash64("v"), "u").limit(SAMPLE).select("v").toPandas()["v"]
    points = np.frombuffer(b"".join(sample)).reshape(-1, max(1, width))
    cells = max(1, min(MOST_CELLS, total // CELL))
    rows = stored(placed(known, width, centres(points, cells)), "place-members")
    # how many blocks each place is cut into: a row for each place, MOST_CELLS or so
    sizes = rows.select(F.explode(F.concat(F.array(F.struct(F.col("home").alias("place"), F.lit(1).alias("own"))), F.transform("visits", lambda c: F.struct(c.alias("place"), F.lit(0).alias("own"))))).alias("s"))
    sizes = sizes.groupBy("s.place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("callers"), F.greatest(F.lit(1), F.ceil(F.sum("s.own") / BLOCK)).cast("int").alias("members"))
    sizes = stored(sizes, "place-sizes")
    spot = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    calls = rows.select("u", "n", "v", "home", F.explode(F.concat(F.array("home"), "visits")).alias("place")).join(sizes, "place")
    calls = calls.withColumn("member", F.lit(False)).withColumn("i", spot("callers")).withColumn("j", every("members"))
    members = rows.withColumn("place", F.col("home")).join(sizes, "place").withColumn("member", F.lit(True)).withColumn("j", spot("members")).withColumn("i", every("callers"))
    columns = ["place", "i", "j", "member", "u", "n", "v", "home"]
    met = calls.select(columns).union(members.select(columns)).groupBy("place", "i", "j").applyInPandas(compare, "u long, links long, root long")
    met = stored(met, "cell-links")
    counts = met.groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("u").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "u")
    return counts.join(roots, "u", "left").select("u", "links", F.coalesce("root", "u").alias("root"))


def near_duplicates(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds n_links, component_id and kept to every row."""
    vectors = ship(without(vectors, "n_links", "component_id", "kept"))
    own = vectors.where(usable(vector)).groupBy(vector).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    own = stored(own.select(F.monotonically_increasing_id().alias("u"), "first", "n", vector), "distinct-vectors")
    known = stored(entries_of(own, vector), "unit-vectors")
    links = linked_entries(known)
    classed = own.join(links, "u", "left").select(vector, "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "u").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = classed.join(least, "root").select(vector, (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    good = vectors.where(usable(vector)).join(facts, vector)
    bad = vectors.where(~usable(vector)).withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    return good.unionByName(bad).select(*vectors.columns, "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def entries_of(own: DataFrame, vector: str) -> DataFrame:
    """u, n, width and unit vector of distinct vectors."""
    each = own.select("u", "first", "n", F.col(vector).cast("array<double>").alias("v"))
    names = ["u", "first", "n", "width", "v"]

    def task(batches):
        for batch in batches:
            widths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            packed = [unit(values[e - w : e].reshape(1, -1)).tobytes() for e, w in zip(np.cumsum(widths), widths)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(widths, pa.int32()), pa.array(packed, pa.binary())], names)

    return each.mapInArrow(task, "u long, first long, n long, width int, v binary")


def report(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors.select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")
