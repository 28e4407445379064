import math

import numpy as np
import pytest

from probanda.llm import neighbours
from probanda.llm.queries import QUERIES


def brute(rows, k=20):
    """For each query row (id, the k nearest rows' (score, id))."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, q) in enumerate(good):
        if i is not None and i % 20 == 0:
            near = [(float((q * v).sum()), j) for other, (j, v) in enumerate(good) if other != at and len(v) == len(q)]
            out.append((i, sorted(near, key=lambda n: (-n[0], n[1] is None, n[1] or 0))[:k]))
    return sorted(out, key=lambda x: x[0])


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert all([n[0] for n in near] == list(range(1, len(near) + 1)) for near in out.values())
    return [(q, [(s, i) for _, s, i in near]) for q, near in sorted(out.items())]


def recall(got, want):
    got = dict(got)
    return sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in want) / sum(len(near) for _, near in want)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_query_recall(spark, monkeypatch):
    """The given vectors, in about 30 leaves: nine in ten neighbours at least, all scores
    those of the original vectors, nearest first."""
    monkeypatch.setattr(neighbours, "LEAF", 64)
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op12_neighbours"](spark, sf)), brute(rows)
    assert [(q, len(n)) for q, n in got] == [(q, len(n)) for q, n in want]
    assert recall(got, want) >= 0.9
    x = {i: np.array(v, np.float64) for i, v in rows}
    assert all(abs(s - float(x[q] @ x[i])) < 1e-12 and i != q for q, near in got for s, i in near)
    assert all(near == sorted(near, key=lambda n: (-n[0], n[1])) for _, near in got)


@pytest.mark.parametrize("leaf, place", [(16, 8192), (64, 50), (100_000, 8192)])
def test_clusters_and_lengths(spark, monkeypatch, leaf, place):
    """Clusters of different norms, a third of all vectors near copies; one leaf: exact."""
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    monkeypatch.setattr(neighbours, "PLACE", place)
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    rng = np.random.default_rng(leaf)
    parts = [rng.standard_normal(12) + 0.1 * rng.standard_normal((500, 12))]
    parts += [rng.uniform(0.2, 4) * (rng.standard_normal(12) + 0.3 * rng.standard_normal((25, 12))) for _ in range(40)]
    x = np.vstack(parts)
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(x)), x)]
    got, want = found(neighbours.report(table(spark, rows))), brute(rows)
    assert [q for q, _ in got] == [q for q, _ in want]
    assert recall(got, want) >= (1 if leaf > len(x) else 0.9)
    if leaf > len(x):
        assert [(q, [i for _, i in n]) for q, n in got] == [(q, [i for _, i in n]) for q, n in want]


def test_fewer_leaves_where_vectors_cluster(spark, monkeypatch):
    """Visits are calibrated: tight clusters need few of the leaves."""
    asked = []
    real = neighbours.calibrated
    monkeypatch.setattr(neighbours, "LEAF", 20)
    monkeypatch.setattr(neighbours, "calibrated", lambda *a: asked.append((real(*a), a[1].leaf.max() + 1)) or asked[-1][0])
    rng = np.random.default_rng(3)
    x = np.vstack([3 * rng.standard_normal(16) + 0.05 * rng.standard_normal((40, 16)) for _ in range(50)])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = found(neighbours.report(table(spark, rows)))
    leaves, of = asked[0]
    assert leaves < of / 4 and recall(got, brute(rows)) >= 0.9


def test_equal_vectors(spark):
    """A vector that a third of all rows share: ties go to the smaller ids, without its own."""
    rows = [(i, [1.0, 2.0]) for i in range(0, 300)] + [(i, [float(i % 7), 1.0]) for i in range(300, 900)]
    got, want = found(neighbours.report(table(spark, rows))), brute(rows)
    assert got == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0]), (3, [1.0, 0.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [nan, 1.0]), (140, [inf, 1.0]),
        (160, [1.0, 0.0, 0.0]), (180, [0.0, 3.0, 1.0]), (None, [0.0, 1.0]), (None, None), (200, [0.0, -1.0]), (13, [-0.0, 1.0]), (-20, [0.5, 0.5]),
    ]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, rank string, score double")
    got = sorted((r.query_id, r.rank, r.score, str(r.vec_id)) for r in neighbours.report(df).collect())
    want = sorted((q, n, s, str(i)) for q, near in brute(rows) for n, (s, i) in enumerate(near, 1))
    assert got == want
    assert neighbours.report(table(spark, [])).collect() == []
    assert neighbours.report(table(spark, [(20, [1.0])])).collect() == []
    assert neighbours.report(table(spark, [(7, [1.0]), (8, [2.0])])).collect() == []
