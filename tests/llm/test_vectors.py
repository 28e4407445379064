import math

import numpy as np
import pytest
from helpers import empty

from probanda.llm import vectors
from probanda.llm.queries import QUERIES


def brute(rows):
    """id → (n_links, component) over usable vectors; pairs"""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(good))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(good)).min(1))
        if (new == label).all():
            break
        label = new
    ids = [rows[i][0] for i in good]
    least = {}
    for i, g in zip(ids, label):
        least[g] = min(i, least.get(g, i))
    out = {i: (0, i) for i, _ in rows}
    out |= {i: (int(n), least[g]) for i, n, g in zip(ids, linked.sum(1), label)}
    return out


def test_query_recall(spark):
    """Against brute force: no link below the threshold, at least 0.9 of those above."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    truth = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op8_vectors"](spark, sf).collect()}
    assert got.keys() == truth.keys()
    assert all(got[i][0] <= truth[i][0] and got[i][2] == (got[i][1] == i) for i in truth)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(t[0] for t in truth.values())


def cluster(rng, n, width=16, noise=0.06):
    base = rng.standard_normal(width)
    base /= np.linalg.norm(base)
    return base + noise * rng.standard_normal((n, width))


def test_many_cells_and_blocks(spark, monkeypatch):
    """A third of all vectors in one group of near copies, cells of many blocks."""
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(4)
    x = np.vstack([cluster(rng, 300), *[cluster(rng, 10) for _ in range(20)], rng.standard_normal((400, 16))])
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(rng.permutation(len(x)), x)]
    truth = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i][0] <= truth[i][0] for i in truth)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(t[0] for t in truth.values())


def test_pairs_just_above_the_threshold(spark):
    """Cosines of 0.9 to 0.92 across many cells of random vectors."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9001, 0.92, (4000, 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * side
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.vstack([x, y]))]
    got = vectors.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0 AND vec_id >= 4000 AND component_id = vec_id - 4000").count() >= 0.9 * 4000


@pytest.mark.parametrize("width, cell", [(8, 20), (16, 20), (32, 4), (64, 2)])
def test_every_pair_is_met(spark, monkeypatch, width, cell):
    """Pairs just above the threshold, few dimensions, up to 2,000 cells: as brute force."""
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", 500)
    rng = np.random.default_rng(width)
    x = rng.standard_normal((2000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9001, 0.92, (2000, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.vstack([x, cosine * x + np.sqrt(1 - cosine**2) * side]))]
    got = vectors.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]),
        (10, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (None, None), (11, [0.0, -1.0]), (12, [1e300, 1e300]), (13, [-0.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, kept string, label string")
    out = vectors.near_duplicates(df)
    assert sorted(out.columns) == ["component_id", "embedding", "kept", "label", "n_links", "vec_id"]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out.collect())
    want = [("1", 3, 1, True), ("2", 3, 1, False), ("3", 3, 1, False), ("3", 3, 1, False), ("13", 1, 13, True), ("None", 1, 13, False), ("None", 0, None, True)]
    want += [(str(i), 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted(want, key=lambda t: (t[0], t[1])) or sorted(map(str, got)) == sorted(map(str, want))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.report(none).collect() == []
