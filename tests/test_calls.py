"""User functions that fail on some items."""

import pytest

from probanda.operators import embed
from probanda.operators.calls import answered


@pytest.mark.parametrize("bad", [set(), {5}, {0, 99}, {63, 64}, set(range(100))])
def test_failures_are_found_by_halving(bad):
    calls = []

    def run(items):
        calls.append(len(items))
        if bad & set(items):
            raise ValueError("no")
        return [2 * i for i in items]

    got = list(answered(run, list(range(100)), 64))
    assert got == [(None, "ValueError: no") if i in bad else (2 * i, None) for i in range(100)]
    assert len(calls) <= 2 + 2 * 6 * len(bad) and max(calls) <= 64


def test_a_wrong_number_of_answers_is_a_failure():
    got = list(answered(lambda items: [i for i in items if i != 3], [1, 2, 3, 4]))
    assert [a for a, _ in got] == [1, 2, None, 4] and got[2][1].startswith("ValueError")
    assert list(answered(lambda items: items, [])) == []


def lengths(bad=()):
    def run(texts):
        if set(bad) & set(texts):
            raise ValueError("no vector")
        return [[float(len(t)), 1.0] for t in texts]

    return lambda: run


def test_a_store_of_vectors_grows(spark, tmp_path):
    """A second run embeds nothing; failed texts are tried again; a batch replaces itself."""
    path = str(tmp_path / "vectors")
    texts = lambda *ts: spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id long, t string")
    run = lambda df, batch, load: {r["t"]: r["embedding"] and r["embedding"][0] for r in embed.embed_into(df, "t", path, batch, load).collect()}
    sizes = lambda: {r["batch"]: r["count"] for r in embed.open_store(spark, path).groupBy("batch").count().collect()}
    first = texts("a", "bb", "a", None, "bad")
    assert run(first, "one", lengths(["bad"])) == {"a": 1.0, "bb": 2.0, None: None, "bad": None}
    assert sizes() == {"one": 2}
    assert run(texts("a", "bb"), "two", lengths()) == {"a": 1.0, "bb": 2.0} and sizes() == {"one": 2}
    assert run(texts("bad", "ccc", "a"), "two", lengths()) == {"bad": 3.0, "ccc": 3.0, "a": 1.0}
    assert run(first, "one", lengths()) == {"a": 1.0, "bb": 2.0, None: None, "bad": 3.0}
    assert sizes() == {"one": 2, "two": 2}
