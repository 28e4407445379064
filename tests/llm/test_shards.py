import zlib
from collections import Counter, defaultdict

from helpers import awkward, empty

from probanda.llm import shards
from probanda.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def check(rows, texts, n=16, slack=0.02):
    """Whole, sizes exact, slots gapless, bytes near equal up to the largest key."""
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    by_id = dict(texts)
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < n
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(loads.values()), max(r.size for r in rows)
    assert all(abs(loads[s] - total / n) <= 2 * largest + slack * total / n for s in range(n)), loads


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op4_shards"](spark, SF).collect(), texts)


def test_hot_group_is_cut(spark, monkeypatch):
    """A third of all rows is one text; several salts number each shard."""
    monkeypatch.setattr(shards, "SALT_ROWS", 20)
    texts = [(i, "the same text " * 10 if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(6000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = shards.report(docs).collect()
    check(rows, texts)
    assert len({r.shard for r in rows if r.doc_id % 3 == 0}) >= 4
    assert {(r.doc_id, r.shard, r.slot) for r in shards.report(docs.repartition(7)).collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_rows_of_one_id_and_text_are_cut(spark, monkeypatch):
    """A third of all rows is one row over again, another third has null ids."""
    monkeypatch.setattr(shards, "SALT_ROWS", 20)
    texts = [(0, "again " * 30) if i % 3 == 0 else (None if i % 3 == 1 else i, f"text {i} " * 10) for i in range(6000)]
    rows = shards.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(t) + 1) for i, t in texts)
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(loads.values()) / 16
    assert len(loads) == 16 and all(abs(n - mean) <= 2 * 181 + 0.02 * mean for n in loads.values()), loads


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = shards.assign(docs)
    assert set(docs.columns) <= set(rows.columns)
    got = rows.collect()
    assert len(got) == 10
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.report(empty(spark)).collect() == []
