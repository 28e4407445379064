"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on at most SAMPLE vectors (fewer where they are wide); every vector of
the table goes down it to a leaf.  A query takes nodes from a priority queue, the most
promising first (product with the node's centre plus what its spread may add), and so
orders the leaves.  How many it visits is calibrated: for CALIBRATION queries the true
neighbours among all rows are found in one blocked pass, and visits widen until TARGET of
those lie in visited leaves.  Runs of leaves with about PLACE vectors are one place;
larger leaves are cut into blocks, as are the queries of a place, and each pair of blocks is
one product in one task that hands on the K + 1 best of each query.

Equal vectors are one entry with its K + 1 smallest rows, and are searched once, so a
vector that a third of all rows share is neither one task nor many results.

Scores are sums of products in double precision, formed alike wherever a vector lies.
Cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of different lengths are no neighbours, those of the rarer lengths are all compared;
rows with a repeated id are rows of their own, and queries of their own; a null id is no
query and ranks last among equals; ties go to the smaller id, then any row; fewer candidates
than K are all returned; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship, stored
from .vectors import usable

K = 20
EVERY = 20  # rows whose id is divisible by this are queries
SAMPLE, SAMPLE_BYTES = 32_768, 64 << 20
BRANCH, ROUNDS = 8, 6
LEAF = 512  # vectors meant for a leaf
LEAST_LEAF = 8  # sampled vectors of a leaf: at most SAMPLE / LEAST_LEAF leaves
CALIBRATION = 256
TARGET = 0.96
PLACE = 8192
QUERIES = 4096  # of one place in one task
CHUNK = 256
SPREAD = 2.0  # standard deviations that a node may add


@dataclass
class Tree:
    centre: np.ndarray  # node × width
    spread: np.ndarray  # standard deviation along one direction
    children: list[list[int]]  # of each node; none: a leaf
    leaf: np.ndarray  # number of a leaf node, -1 of others, in tree order

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_rows: int) -> "Tree":
        tree = cls([], [], [], [])
        if len(sample):
            tree.grow(sample, leaf_rows, np.random.default_rng(17))
        else:
            tree.node(np.zeros((1, sample.shape[1])))
        leaf = np.array([-1 if c else 0 for c in tree.children])
        leaf[leaf == 0] = np.arange((leaf == 0).sum())
        return cls(np.array(tree.centre), np.array(tree.spread), tree.children, leaf)

    def node(self, points: np.ndarray) -> int:
        centre = points.mean(0)
        self.centre.append(centre)
        self.spread.append(np.sqrt(((points - centre) ** 2).mean()))
        self.children.append([])
        return len(self.centre) - 1

    def grow(self, points: np.ndarray, leaf_rows: int, rng) -> int:
        """Depth first, so that neighbouring leaves have neighbouring numbers."""
        own = self.node(points)
        if len(points) > leaf_rows:
            home = parted(points, min(BRANCH, -(-len(points) // leaf_rows)), rng)
            parts = [points[home == c] for c in range(home.max() + 1)]
            if len(parts) > 1:
                self.children[own] = [self.grow(p, leaf_rows, rng) for p in parts]
        return own

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node."""
        at = np.zeros(len(rows), np.int64)
        waiting = [0]
        while waiting:
            node = waiting.pop()
            if self.children[node]:
                here = np.flatnonzero(at == node)
                if len(here):
                    children = np.array(self.children[node])
                    at[here] = children[nearest(rows[here], self.centre[children])]
                    waiting += self.children[node]
        return self.leaf[at]

    def order(self, queries: np.ndarray):
        """For each query its leaves, the most promising first, as they are asked for."""
        length = np.sqrt((queries * queries).sum(1, keepdims=True))
        promise = -(queries @ self.centre.T + SPREAD * length * self.spread)
        for row in promise.tolist():
            yield self.best_first(row)

    def best_first(self, promise: list[float]):
        queue = [(promise[0], 0)]
        while queue:
            _, node = heappop(queue)
            if not self.children[node]:
                yield int(self.leaf[node])
            for child in self.children[node]:
                heappush(queue, (promise[child], child))


def nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points * points).sum(1) / 2 - rows @ points.T).argmin(1)


def parted(points: np.ndarray, parts: int, rng) -> np.ndarray:
    """k-means: the part of each point, numbered without gaps."""
    middle = points[rng.permutation(len(points))[:parts]].copy()
    for _ in range(ROUNDS):
        home = nearest(points, middle)
        for c in range(len(middle)):
            if (home == c).any():
                middle[c] = points[home == c].mean(0)
    return np.unique(nearest(points, middle), return_inverse=True)[1]


def rows_in(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, width)


def packed(entries: DataFrame) -> DataFrame:
    """u, first, width and the vector as bytes."""

    def task(batches):
        for batch in batches:
            widths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            blobs = [values[e - w : e].tobytes() for e, w in zip(np.cumsum(widths).tolist(), widths.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(widths, pa.int32()), pa.array(blobs, pa.binary()), batch.column(3)], ["u", "first", "width", "v", "asks"])

    return entries.select("u", "first", "v", "asks").mapInArrow(task, "u long, first long, width int, v binary, asks boolean")


def leafed(known: DataFrame, tree: Tree, width: int) -> DataFrame:
    """Adds the leaf; vectors of another length than ``width`` share one below zero."""
    shared = known.sparkSession.sparkContext.broadcast(tree)

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                widths = part.column(2).to_numpy()
                leaf, same = np.negative(widths.astype(np.int64)), np.flatnonzero(widths == width)
                if len(same):
                    leaf[same] = shared.value.leaves_of(rows_in(part.column(3).take(pa.array(same)), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf, pa.int32())], [*part.schema.names, "leaf"])

    return known.mapInArrow(task, "u long, first long, width int, v binary, asks boolean, leaf int")


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows of x by score, then id (and those that tie with the
    last of them): query places, row places, scores."""
    with np.errstate(all="ignore"):
        product = q @ x.T
        product[np.isnan(product)] = -np.inf
        if seen is not None:
            product[~seen] = -np.inf
        last = np.partition(product, len(x) - min(k, len(x)), axis=1)[:, [len(x) - min(k, len(x))]]
        slack = 1e-10 * np.sqrt((q * q).sum(1, keepdims=True) * (x * x).sum(1).max())
        open_ = product >= last - np.nan_to_num(slack)
        if seen is not None:
            open_ &= seen
        i, j = np.nonzero(open_)
        score = np.concatenate([np.zeros(0), *[(q[i[s : s + 8192]] * x[j[s : s + 8192]]).sum(1) for s in range(0, len(i), 8192)]])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    chosen = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[chosen], j[chosen], score[chosen]


def truth(known: DataFrame, queries: list, k: int) -> DataFrame:
    """q, leaf of the k nearest entries, the query's own aside, of a few queries."""
    ids = np.array([r["u"] for r in queries])
    shared = known.sparkSession.sparkContext.broadcast((ids, rows_in(pa.array([r["v"] for r in queries]), queries[0]["width"])))
    width = queries[0]["width"]

    def task(batches):
        ids, points = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                part = part.filter(pa.array(part.column(2).to_numpy() == width))
                if part.num_rows:
                    u = part.column(0).to_numpy()
                    i, j, score = best_of(points, rows_in(part.column(3), width), u, k, ids[:, None] != u)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(u[j]), part.column(5).take(pa.array(j)), pa.array(score)], ["q", "u", "leaf", "score"])

    found = known.mapInArrow(task, "q long, u long, leaf int, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "u")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "leaf")


def calibrated(known: DataFrame, tree: Tree, width: int, target: float, k: int) -> int:
    """Leaves to visit so that ``target`` of the true neighbours of sampled queries are met."""
    asking = known.where(F.col("asks") & (F.col("width") == width))
    queries = asking.orderBy(F.xxhash64("v", F.lit(3)), "u").limit(CALIBRATION).select("u", "width", "v").collect()
    if not queries:
        return 1
    near: dict[int, list[int]] = {}
    for r in truth(known, queries, k).collect():  # CALIBRATION × k rows
        near.setdefault(r["q"], []).append(r["leaf"])
    reached = np.zeros(tree.leaf.max() + 2, np.int64)
    for r, leaves in zip(queries, tree.order(rows_in(pa.array([r["v"] for r in queries]), width))):
        step = {leaf: n for n, leaf in enumerate(leaves, 1)}
        for leaf in near.get(r["u"], []):
            reached[step[leaf]] += 1
    share = np.cumsum(reached) / max(1, reached.sum())
    return max(1, int(np.searchsorted(share, target - 1e-12)))


def places(counts: np.ndarray) -> np.ndarray:
    """The place of each leaf: runs of leaves of about PLACE vectors."""
    place, number, load = np.zeros(len(counts), np.int64), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if load and load + n > PLACE:
            number, load = number + 1, 0
        place[leaf], load = number, load + n
    return place


def visits(known: DataFrame, tree: Tree, width: int, leaves: int, counts: np.ndarray, place: np.ndarray, k: int) -> DataFrame:
    """q, v, place and the leaves there, of each asking entry."""
    shared = known.sparkSession.sparkContext.broadcast((tree, counts.tolist(), place.tolist()))

    def task(batches):
        tree, counts, place = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                widths, ids, blobs = part.column(2).to_numpy(), part.column(0).to_pylist(), part.column(3).to_pylist()
                same = np.flatnonzero(widths == width)
                rows = [(ids[i], blobs[i], int(-widths[i]), [int(-widths[i])]) for i in np.flatnonzero(widths != width).tolist()]
                ordered = tree.order(rows_in(part.column(3).take(pa.array(same)), width)) if len(same) else ()
                for i, order in zip(same.tolist(), ordered):
                    met: dict[int, list[int]] = {}
                    seen = 0
                    for n, leaf in enumerate(order):
                        if n >= leaves and seen > k:
                            break
                        seen += counts[leaf]
                        met.setdefault(place[leaf], []).append(leaf)
                    rows += [(ids[i], blobs[i], p, where) for p, where in met.items()]
                if rows:
                    q, v, p, where = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.binary()), pa.array(p, pa.int32()), pa.array(where, pa.list_(pa.int32()))], ["q", "v", "place", "leaves"])

    return known.where("asks").mapInArrow(task, "q long, v binary, place int, leaves array<int>")


def search(queries: pa.Table, members: pa.Table, k: int) -> pa.Table:
    """One block of queries against one block of members of a place."""
    names = ["q", "u", "first", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    out = [pa.table([pa.array([], t) for t in kinds], names)]
    if queries.num_rows and members.num_rows:
        width = len(members["v"][0].as_py()) // 8
        x, leaf = rows_in(members["v"], width), members["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        x, leaf, u, first = x[order], leaf[order], members["u"].to_numpy()[order], members["first"].take(pa.array(order))
        ids = first.fill_null(np.iinfo(np.int64).max).to_numpy()
        present, starts = np.unique(leaf, return_index=True)
        ends = np.append(starts[1:], len(leaf))
        for start in range(0, queries.num_rows, CHUNK):
            part = queries.slice(start, CHUNK)
            asked = np.zeros((part.num_rows, len(present)), bool)
            for i, where in enumerate(part["leaves"].to_pylist()):
                asked[i] = np.isin(present, where)
            some = np.flatnonzero(asked.any(0))
            if not len(some):
                continue
            # leaves that no query of the chunk visits are left out of the product
            rows = np.concatenate([np.arange(starts[s], ends[s]) for s in some])
            seen = np.repeat(asked[:, some], ends[some] - starts[some], axis=1)
            i, j, score = best_of(rows_in(part["v"], width), x[rows], ids[rows], k, seen)
            j = rows[j]
            out.append(pa.table([pa.array(part["q"].to_numpy()[i]), pa.array(u[j]), first.take(pa.array(j)), pa.array(score)], names))
    return pa.concat_tables([t.cast(pa.schema(list(zip(names, kinds)))) for t in out])


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: u, v, first (smallest id), members (its k + 1 smallest rows), asks."""
    order = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"), "uid")
    few = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    each = few.groupBy("v").agg(F.min("id").alias("first"), F.sort_array(F.collect_list(F.struct("r", "id", "uid"))).alias("members"))
    asking = rows.where("asks").select("v").distinct().withColumn("asks", F.lit(True))
    each = each.join(asking, "v", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    return each.withColumn("u", F.monotonically_increasing_id())


def nearest_entries(entries: DataFrame, k: int, target: float) -> DataFrame:
    """q, u, score: the k best entries found for every asking entry, its own included."""
    known = stored(packed(entries), "neighbour-vectors")
    widths = known.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    width, total = (widths[0]["width"], widths[0]["count"]) if widths else (1, 0)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = known.where(F.col("width") == width).orderBy(F.xxhash64("v"), "u").limit(most).select("v").toArrow()["v"]
    tree = Tree.fit(rows_in(sample, width), max(LEAST_LEAF, LEAF * len(sample) // max(1, total)))
    known = stored(leafed(known, tree, width), "neighbour-leaves")
    counts = np.zeros(tree.leaf.max() + 1, np.int64)
    for r in known.where("leaf >= 0").groupBy("leaf").count().collect():  # a row for each leaf
        counts[r["leaf"]] = r["count"]
    place = places(counts)
    leaves = calibrated(known, tree, width, target, k - 1)
    asked = stored(visits(known, tree, width, leaves, counts, place, k), "neighbour-visits")
    of = known.sparkSession.createDataFrame([(leaf, int(p)) for leaf, p in enumerate(place)], "leaf int, place int")
    members = known.join(F.broadcast(of), "leaf", "left").withColumn("place", F.coalesce("place", "leaf"))
    cut = lambda df, size, name: df.groupBy("place").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = stored(cut(members, PLACE, "blocks").join(cut(asked, QUERIES, "groups"), "place"), "neighbour-places")
    spot = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "place").withColumn("j", spot("q", "groups")).withColumn("i", every("blocks")).select("place", "i", "j", "q", "v", "leaves")
    right = members.join(sizes, "place").withColumn("i", spot("u", "blocks")).withColumn("j", every("groups")).select("place", "i", "j", "u", "first", "v", "leaf")
    keys = ["place", "i", "j"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both have the place sizes
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: search(a, b, k), "q long, u long, first long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("first"), "u")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "u", "score")


def neighbours(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each query."""
    rows = ship(vectors).where(usable(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False)).alias("asks")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "v", asks), "neighbour-rows")
    entries = stored(entries_of(rows, k), "neighbour-entries")
    found = nearest_entries(entries, k + 1, target)
    each = found.join(entries.select("u", F.explode("members").alias("m")), "u").select("q", "score", "m.id", "m.uid")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    each = each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "uid", "score"))).alias("near"))
    asking = rows.where("asks").join(entries.select(F.col("u").alias("q"), "v"), "v").select(F.col("id").alias("query_id"), F.col("uid").alias("own"), "q")
    near = F.slice(F.filter("near", lambda n: n["uid"] != F.col("own")), 1, k)
    out = asking.join(lists, "q").select("query_id", F.posexplode(near).alias("at", "n"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score"))


def report(vectors: DataFrame) -> DataFrame:
    return neighbours(vectors)
