import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, empty

from probanda.llm import divergence

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, best=10):
    """Rows of (lang, source, text) by the definition."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own, docs = {}, Counter()
        for _, source, text in (r for r in rows if r[0] == lang):
            terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
            own.setdefault(source, Counter()).update(terms)
            docs.update(set(terms))
        kept = [t for t in docs if docs[t] >= least]
        v, total = len(kept), Counter({t: sum(c[t] for c in own.values()) for t in kept})
        p = lambda c, n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(total, sum(total.values()))
        ps = {s: p(c, sum(c[t] for t in kept)) for s, c in own.items()}
        for s in own:
            pair = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in own if o != s]
            term = [(t, f(ps[s][t], q[t])) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, best)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, x, i) for i, (item, x) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def prose(seed, n, langs, sources):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgÖé漢" for b in ["", "x", "Yz", "ß"]]
    rows = []
    for _ in range(n):
        source = rng.choice(sources)
        liked = words[: 5 + hash(str(source)) % 20] if rng.random() < 0.6 else words
        rows.append((rng.choice(langs), source, "".join(rng.choice(liked) + rng.choice([" ", ", ", "1", "\n", "_"]) for _ in range(rng.randrange(40)))))
    return rows


@pytest.mark.parametrize("terms, tile, held", [(1024, 128, 300_000), (4, 3, 30), (1, 1, 1)])
def test_brute_force(spark, monkeypatch, terms, tile, held):
    """Also with many cells, tiles and partial counts."""
    for name, size in (("TERMS", terms), ("TILE", tile), ("HELD", held), ("CHUNK", max(2, terms // 2))):
        monkeypatch.setattr(divergence, name, size)
    rows = prose(terms, 400, ["en", "de", None, ""], ["a", "b", None, "Ünï", "z", "zz"])
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert rows_of(divergence.report(docs)) == brute(rows)


def test_hot_source(spark):
    """A third of the rows from one source, one term everywhere."""
    rows = prose(9, 200, ["en"], ["a", "b", "c"]) + [("en", "hot", "same same term")] * 100
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(divergence.report(docs)) == brute(rows)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband_keeps_what_few_dominate(monkeypatch, k):
    monkeypatch.setattr(divergence, "CHUNK", 16)
    rng = np.random.default_rng(k)
    n, total, term = rng.integers(1, 9, 300), rng.integers(1, 9, 300), [f"t{i:03}".encode() for i in rng.permutation(300)]
    rows = pa.table({"term": term, "n": n, "total": total})
    want = {
        t for a, b, t in zip(n, total, term)
        if sum(x >= a and y <= b and u < t for x, y, u in zip(n, total, term)) < k
    }
    assert set(divergence.skyband(rows, k)["term"].to_pylist()) == want
    halves = pa.concat_tables([divergence.skyband(rows.slice(0, 130), k), divergence.skyband(rows.slice(130), k)])
    assert set(divergence.skyband(halves, k)["term"].to_pylist()) == want


def test_large_counts_stay_exact(spark):
    row = spark.createDataFrame([(10**13, 10**15, 10**6, 10**9, 1)], "c long, n long, v long, p long, q long")
    got = row.select(divergence.share("c", "n", "v").alias("s"), divergence.value("p", "q").alias("f")).first()
    assert tuple(got) == (1 + 10**9 * (10**13 + 2) // (10**15 + 2 * 10**6), (10**9 - 1) ** 2 // (10**9 + 1))


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert rows_of(divergence.report(docs)) == brute(rows)
    few = [("en", "a", None), ("en", "b", ""), (None, None, "1 2 3"), ("en", "c", "x"), ("en", "c", "x")]
    assert rows_of(divergence.report(spark.createDataFrame(few, "lang string, source string, text string"))) == brute(few) != []
    assert divergence.report(empty(spark)).collect() == []
