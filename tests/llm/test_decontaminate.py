import hashlib
import re
import sys
from pathlib import Path

import pytest
from helpers import awkward, documents, empty

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import connect, difference

from probanda.llm import decontaminate
from probanda.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    patterns = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            patterns.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for p, names in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= names
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


DOCS = [(1, "a b c d e f g h i j k"), (2, "x A-b c! d e f g h i j k short one y"), (3, "short ONE short one"), (4, "é b short"), (5, ""), (6, "one one one two")]
ITEMS = [(10, "a b c d e f g h i j k l"), (11, "short one"), (12, "É"), (13, None), (14, "b c d e f g h i j k"), (9, "short one"), (15, "é"), (16, "one one")]


@pytest.mark.parametrize("limit", [200_000, 3])
def test_small_tables_equal_brute_force(spark, monkeypatch, limit):
    """Also with the windows in several blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(decontaminate.report(docs, items)) == brute(DOCS, ITEMS)
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {5}


def test_given_tables_equal_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in documents(spark) if len(t) < 3000]
    got = rows(QUERIES["op1_decontamination"](spark, "/root/testdata/sf0.001"))
    assert {i: got[i] for i, _ in docs} == brute(docs, items)
    assert len(got) == 200


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(QUERIES["op1_decontamination"](spark, sf), connect(sf), SQL["op1_decontamination"]) is None


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "alpha beta gamma"), (None, "delta"), (None, None), (1, "alpha beta gamma")], "item_id long, text string")
    out = decontaminate.find(docs, items).collect()
    assert len(out) == 10
    hit = [r for r in out if r.text and r.text.startswith("alpha")]
    assert all(r.n_hit == 4 and r["items"] == ["1"] for r in hit) and len(hit) == 4
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == 6
    assert decontaminate.report(docs, empty(spark).selectExpr("doc_id as item_id", "text")).where("contaminated").count() == 0
    assert decontaminate.report(empty(spark), items).collect() == []
