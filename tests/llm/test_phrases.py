import re
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F

from probanda.llm import common, phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, best):
    """Rows of (lang, text) by the definition, phrase by phrase."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for s in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[s : s + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {}
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        for p, a in often.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            inside = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in inside):
                found[p] = (a, *min(cuts)[2:], min(cuts)[0])
        order = sorted(found.items(), key=lambda x: (-x[1][3], -x[1][0], " ".join(x[0]).encode()))[:best]
        out += [(lang, i, " ".join(p), a, l, r, n[lang], score) for i, (p, (a, l, r, score)) in enumerate(order, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def prose(seed, n, words):
    rng = random.Random(seed)
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " !? ", "\r\n"]
    return [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("block, window", [(1 << 19, 1 << 20), (7, 9), (40, 5), (3, 1000)])
def test_brute_force(spark, monkeypatch, block, window):
    """Also where blocks and slices end inside pieces."""
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "SLICE", window)
    monkeypatch.setattr(phrases, "BUFFERED", 4 * block)
    rows = prose(block, 300, "a B b of Öl ÖL the 漢字 x y 'q'".split(" "))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.collocations(docs, least=6, best=25)) == brute(rows, 6, 25)


def test_one_endless_piece(spark, monkeypatch):
    """No end of a piece in a long text; a third of all words are one phrase."""
    monkeypatch.setattr(phrases, "BLOCK", 500)
    monkeypatch.setattr(phrases, "SLICE", 300)
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choice(["hot spot", "a", "b", "c", "d", "e"]) for _ in range(5000)))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.collocations(docs)) == brute(rows, 30, 2000)


def test_filter_lets_every_common_hash_through(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 64, 4000, np.uint64)
    keys = phrases.keys_of(hashes[:2000], 64)
    found = phrases.Filter.of(spark.createDataFrame([(int(k),) for k in keys], "key long"), 64)
    assert found.has(hashes[:2000]).all() and found.has(hashes[2000:]).mean() < 0.1
    assert len(set(keys)) == 2000 and keys.max() < 64 << 32


@pytest.mark.parametrize("which", ["filter", "hashes"])
def test_what_comes_through_wrongly_changes_nothing(spark, monkeypatch, which):
    """A full filter, or hashes that collide: more comes through, the counts stay exact."""
    if which == "filter":
        full = np.full(1 << 10, (1 << 64) - 1, np.uint64)
        monkeypatch.setattr(phrases.Filter, "of", lambda keys, pieces: phrases.Filter(pieces, 1 << 16, full))
    else:
        monkeypatch.setattr(phrases, "_FACTOR", np.uint64(0))
    rows = prose(5, 200, "a b c d".split())
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.collocations(docs, least=20, best=10)) == brute(rows, 20, 10)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert rows_of(phrases.report(docs)) == brute(rows, 30, 2000) != []
    assert phrases.report(empty(spark)).collect() == []
    blank = spark.createDataFrame([(None, None), ("en", ""), ("en", " \n\t ")], "lang string, text string")
    assert phrases.report(blank).collect() == []


def test_few_large_rows_are_held_at_once(spark):
    """Rows as large as blocks reach a task in batches of BATCH_BYTES, and only meanwhile."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    most = lambda: max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect())
    before = most()
    with common.small_batches(spark):
        assert most() <= 2 * common.BATCH_BYTES >> 20 < before
    assert most() == before


def test_row_groups_hold_few_blocks(spark):
    """A reader is handed a row group at once: a task's blocks lie in many."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(rng.bytes(1 << 20),) for _ in range(48)], "hashes binary").coalesce(1)
    written = common.stored(rows, "blocks-test", **phrases._WRITE)
    groups = pq.ParquetFile(written.inputFiles()[0].removeprefix("file:").replace("//", "/")).metadata
    sizes = [groups.row_group(i).num_rows for i in range(groups.num_row_groups)]
    assert sum(sizes) == 48 and max(sizes) <= 16
    assert written.selectExpr("sum(length(hashes))").first()[0] == 48 << 20
