"""Keyword search over stored postings against brute force."""

import random

import pytest

from probanda.operators import postings
from probanda.session import shared_dir


def brute(queries, texts, k):
    out = []
    for q, tokens in queries:
        tokens = set(tokens or [])
        found = [(-len(tokens & set(t or [])) / len(tokens), i) for i, t in texts if tokens and i is not None]
        out += [(q, i, round(-s, 9), n) for n, (s, i) in enumerate(sorted(f for f in found if f[0] < 0)[:k], 1)]
    return sorted(out)


def index_of(spark, texts):
    df = spark.createDataFrame(texts, "id long, tokens array<string>").repartition(4)
    return postings.store_postings(df, shared_dir(spark, "test-postings"))


def asked(spark, queries):
    return spark.createDataFrame(queries, "query_id string, tokens array<string>")


@pytest.mark.parametrize("length", [4096, 5])
def test_equals_brute_force(spark, monkeypatch, length):
    """A token of every text, one of a third, rare ones; texts and queries without tokens."""
    monkeypatch.setattr(postings, "LIST", length)
    rng = random.Random(length)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, ["the", *(["third"] if i % 3 == 0 else []), *rng.sample(words, rng.randrange(8))]) for i in range(400)]
    texts += [(1000, []), (1001, None), (None, ["the"])]
    queries = [(f"q{n}", ["the", "third", "nowhere", *rng.sample(words, 1 + n % 6)]) for n in range(20)]
    queries += [("common", ["the"]), ("none", []), ("null", None), ("unknown", ["nowhere"]), ("twice", ["w1", "w1", "the"])]
    got = postings.keyword_top_k(asked(spark, queries), index_of(spark, texts), 7).collect()
    assert sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in got) == brute(queries, texts, 7)


def test_common_tokens_are_not_looked_up(spark):
    """Once ten texts share the rare tokens, the list of the commonest cannot help."""
    texts = [(i, ["the", "of", *(["rare", "seldom"] if i < 12 else [])]) for i in range(500)]
    queries, index = asked(spark, [("q", ["the", "of", "rare", "seldom"])]), index_of(spark, texts)
    tokens = postings.ranked_tokens(queries, index)
    left = postings.essential(tokens, postings.floors(tokens, queries, index, 10))
    assert {r["token"] for r in left.collect()} <= {"rare", "seldom"}
    assert [r["id"] for r in postings.keyword_top_k(queries, index, 10).orderBy("rank").collect()] == list(range(10))
