"""Retrieval against brute force, with ties, small blocks and hot documents."""

import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from probanda.catalog.inputs import Inputs
from probanda.functions import text as T
from probanda.operators import chunk_index, compare, ranking, retrieve
from probanda.plans import ask, research
from probanda.session import shared_dir

CHUNK = (
    "chunk_id string, document_id string, ingest_order long, chunk_index int, concept_id string, "
    "chunk_text string, embedding array<double>"
)


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, CHUNK).withColumn("tokens", T.tokens(F.col("chunk_text")))


def document_table(spark, ids):
    return spark.createDataFrame([(i, f"Title {i}") for i in ids], "id string, title string")


def queries(spark, rows):
    return spark.createDataFrame(
        rows, "query_id string, query string, embedding array<double>, document_id string, top_k int, min_score double"
    )


def golden(spark):
    texts = ["cats are small animals", "volcanoes erupt", "stock markets move"]
    rows = [(f"c{i}", "A" if i < 2 else "B", i, 0, None, t, [float(i == j) for j in range(3)]) for i, t in enumerate(texts)]
    return chunk_table(spark, rows), document_table(spark, ["A"])


def test_golden_scores(spark):
    chunks, docs = golden(spark)
    q = queries(spark, [
        ("all", "cats", [1.0, 0.0, 0.0], None, 5, 0.0), ("best", " cats\n", [1.0, 0.0, 0.0], None, 5, 0.9),
        ("blank", " \t", [1.0, 0.0, 0.0], None, 5, 0.0), ("failed", "cats", None, None, 5, 0.0),
        ("in B", "cats", [1.0, 0.0, 0.0], "B", 5, 0.0), ("zero", "cats", [0.0, 0.0, 0.0], None, 1, 0.0),
    ])
    got = {}
    for r in retrieve.retrieve(q, chunks, docs).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"], r["document_title"]))
    assert got == {
        "all": [("c0", 1.0, "Title A"), ("c1", 0.0, "Title A"), ("c2", 0.0, None)],
        "best": [("c0", 1.0, "Title A")],
        "in B": [("c2", 0.0, None)],
        "zero": [("c0", 0.3, "Title A")],
    }


@pytest.mark.parametrize("block,broadcast", [(3, 32 << 20), (512, 32 << 20), (3, 0)])
def test_matches_brute_force_with_hot_document(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", broadcast)
    rng = random.Random(11)
    words = "alpha beta gamma delta eps".split()
    chunks, vectors = [], {}
    for i in range(900):
        # a third of all chunks belongs to one document, many are exact copies
        doc = "hot" if i % 3 == 0 else f"d{i % 40}"
        text = "alpha beta" if i % 4 == 0 else " ".join(rng.choices(words, k=3))
        v = [1.0, 0.0] if i % 4 == 0 else [rng.uniform(-1, 1), rng.uniform(-1, 1)]
        chunks.append((f"c{i:04}", doc, i % 7, i, None, text, v))
    table = chunk_table(spark, chunks).repartition(8)
    asked = []
    for n in range(20):
        doc = None if n % 3 else ("hot" if n % 2 else "d4")
        asked.append((f"q{n}", " ".join(rng.choices(words, k=2)), [rng.uniform(-1, 1), 1.0], doc, 1 + n % 6, [0.0, 0.3, -2.0][n % 3]))
    got = {}
    found = retrieve.retrieve(queries(spark, asked), table, document_table(spark, ["hot"]), block_queries=block)
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"]))
    for qid, text, v, doc, k, floor in asked:
        scored = []
        for cid, d, order, index, _, ctext, e in chunks:
            if doc is not None and d != doc:
                continue
            cos = float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e))
            kw = len(set(text.split()) & set(ctext.split())) / len(set(text.split()))
            score = np.floor((0.7 * cos + 0.3 * kw) * 1e12 + 0.5) / 1e12
            if score >= floor:
                scored.append((-score, order, index, cid))
        wanted = [(n + 1, s[3]) for n, s in enumerate(sorted(scored)[:k])]
        assert sorted(got.get(qid, [])) == wanted, qid


def test_dimension_mismatch_is_an_error(spark):
    chunks, docs = golden(spark)
    with pytest.raises(Exception, match="dimension mismatch"):
        retrieve.retrieve(queries(spark, [("q", "cats", [1.0, 0.0], None, 5, 0.0)]), chunks, docs).collect()


def test_blocks_hold_every_query_once(spark):
    """Also where one id is asked with many texts; equal rows are one query."""
    rows = [("same", f"cats {n % 9}", [float(n % 9)], None, 1, 0.0) for n in range(18)] + [(f"q{n}", "cats", [1.0], None, 1, 0.0) for n in range(30)]
    blocks = ranking.query_blocks(retrieve.prepare_queries(queries(spark, rows).repartition(3)), 4).collect()
    assert max(len(b["queries"]) for b in blocks) <= 4 and len({b["block"] for b in blocks}) == len(blocks)
    assert sorted(q["query_id"] for b in blocks for q in b["queries"]) == sorted(["same"] * 9 + [f"q{n}" for n in range(30)])


def clustered(rng, n, width=16):
    """Chunks in 20 tight clusters, each with words of its own; rows and their vectors."""
    middles = rng.standard_normal((20, width))
    rows = []
    for i in range(n):
        c = int(rng.integers(20))
        v = middles[c] + 0.05 * rng.standard_normal(width)
        rows.append((f"c{i:05}", f"d{i % 50}", i, i, None, f"common word{c} other{i % 3}", [float(x) for x in v]))
    return middles, rows


def best_of(rows, text, vector, k, floor=0.0):
    q = np.array(vector) / np.linalg.norm(vector)
    out = []
    for cid, _, order, index, _, ctext, v in rows:
        words = set(text.split())
        score = 0.7 * float(q @ np.array(v) / np.linalg.norm(v)) + 0.3 * len(words & set(ctext.split())) / len(words)
        out.append((-round(score, 12), order, index, cid))
    return [cid for s, _, _, cid in sorted(out)[:k] if -s >= floor]


def test_far_groups_are_passed_over(spark, monkeypatch):
    """Clustered chunks in a stored index: most (query, group) pairs are never scored, and
    the answers are those of brute force, by either join."""
    rng = np.random.default_rng(5)
    middles, rows = clustered(rng, 6000)
    asked = [(f"q{n}", f"word{n % 20} common", [float(x) for x in middles[n % 20] + 0.1 * rng.standard_normal(16)], None, 5, 0.0) for n in range(40)]
    table = chunk_table(spark, rows).repartition(4)
    index = chunk_index.store_index(table, shared_dir(spark, "test-index"))
    wanted = {a[0]: best_of(rows, a[1], a[2], 5) for a in asked}

    def found(source):
        got = {}
        for r in retrieve.retrieve(queries(spark, asked), source).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        return got

    assert found(index) == wanted
    assert found(chunk_index.open_index(spark, *[index.groups.inputFiles()[0].rsplit("/", 1)[0]], table)) == wanted
    tally = Counter()
    joined = ranking.met(ranking.query_blocks(retrieve.prepare_queries(queries(spark, asked))), index).toArrow()
    assert sum(b.num_rows for b in ranking.search_batches(joined.to_batches(max_chunksize=16), ranking.Weights(), tally)) >= 200
    assert tally["scored"] < tally["pairs"] / 4
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 0)
    assert found(index) == wanted and found(table) == wanted


def test_chunks_are_handed_over_once(spark):
    """However many blocks of queries there are, no join copies the chunks for each of them,
    and no text is shuffled to the winners."""
    rows = [(f"c{i:02}", "A", i, i, None, f"cats word{i % 7}", [1.0, float(i)]) for i in range(40)]
    asked = [(f"q{n}", f"cats word{n % 7}", [1.0, float(n)], None, 2, 0.0) for n in range(24)]
    found = retrieve.retrieve(queries(spark, asked).drop("document_id"), chunk_table(spark, rows), block_queries=2)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {a[0]: best_of(rows, a[1], a[2], 2) for a in asked}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "strategy=broadcast" in plan


def test_a_block_grows_with_its_tokens(spark):
    """A task holds every block: none keeps a matrix of all queries and all their tokens."""
    asked = [(f"q{n}", " ".join(f"w{n}x{i}" for i in range(40)), [1.0, float(n)], None, 2, 0.0) for n in range(512)]
    rows = ranking.query_blocks(retrieve.prepare_queries(queries(spark, asked)).coalesce(1)).toArrow()["queries"].combine_chunks()
    blocks = [ranking.QueryBlock.of(row.values) for row in rows]
    held = sum(x.nbytes for b in blocks for x in vars(b).values())
    assert sum(len(b.ids) for b in blocks) == 512 and held < 4 << 20


def test_chunks_are_stored_not_held(spark, tmp_path):
    """A search reads chunks twice; executors hold none of them meanwhile, and the texts are
    not read for their vectors."""
    spark.createDataFrame([(n, f"text {n} " * 300, "en", "s") for n in range(6)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [1.0, float(n)], 0) for n in range(4)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    chunks = Inputs(spark, str(tmp_path)).chunks
    assert chunks.count() == 6 * 3 and chunks.where("embedding is null").count() == 0
    assert not chunks.is_cached and chunks.inputFiles()
    plan = chunks.select("chunk_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "chunk_text" not in plan and "Exchange" not in plan


def test_an_index_has_one_dimension(spark):
    rows = [(f"c{i}", "A", i, 0, None, "x", [1.0] * (2 + i // 3)) for i in range(4)]
    with pytest.raises(ValueError, match="several dimensions"):
        chunk_index.store_index(chunk_table(spark, rows), shared_dir(spark, "mixed"))


def test_bounds_hold(spark):
    """No member of a group scores above its bound, zero vectors and queries included."""
    rng = np.random.default_rng(8)
    _, rows = clustered(rng, 700, 6)
    rows += [(f"z{i}", "z", i, i, None, "zero words", [0.0] * 6) for i in range(5)]
    rows += [("n1", "z", 1, 1, None, "x", [float("nan")] * 6), ("n2", "z", 1, 1, None, "x", None)]
    asked = [(f"q{n}", "word1 zero words common", [float(x) for x in rng.standard_normal(6)], None, 3, -9.0) for n in range(20)]
    asked.append(("zero", "words", [0.0] * 6, None, 3, -9.0))
    joined = ranking.met(ranking.query_blocks(retrieve.prepare_queries(queries(spark, asked))), chunk_index.indexed(chunk_table(spark, rows))).toArrow()
    weights, members = ranking.Weights(), 0
    for batch in joined.to_batches():
        for i in range(batch.num_rows):
            block, group = ranking.QueryBlock.of(batch.column("queries")[i].values), ranking.Group.of(batch, i)
            every = np.arange(len(block.ids))
            score = ranking.scores(block, group, ranking.shared_tokens(block, group), every, weights)[0]
            assert (score.max(axis=1) <= ranking.bound(block, group, weights)).all()
            members += len(group.vectors)
    assert members == 705


def test_raw_scores_decide(spark):
    """A score just below the floor is not rounded up to it, one just above another wins."""
    v = [1.0, 0.0]
    chunks = chunk_table(spark, [("low", "A", 0, 0, None, "x", [-3e-7, 1.0]), ("a", "A", 1, 0, None, "x", [1e-4, 1.0]), ("b", "A", 2, 0, None, "x", [1e-4 + 2e-7, 1.0])])
    got = retrieve.retrieve(queries(spark, [("q", "cats", v, None, 5, 0.0), ("in A", "cats", v, "A", 5, 0.0)]), chunks).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == [(q, c, 0.00007) for q in ("in A", "q") for c in "ba"]


def compared(spark, *texts):
    rows = [("q", i + 1, f"c{i}", f"d{i}" if t != "same" else "d0", None, None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, document_id string, url string, concept_id string, chunk_text string")
    return [(r["overlap_ratio"], r["relation"]) for r in compare.compare_sources(df).collect()]


def test_comparison_golden(spark):
    assert compared(spark, "one two three", "three two one") == [(1.0, "agreement")]
    assert compared(spark, "one two three", "four five six")[0][1] == "divergence"
    assert compared(spark, "alone") == []
    assert compared(spark, "...", "!!!") == [(0.0, "divergence")]
    assert len(compared(spark, "a", "b", "c", "d")) == 6


def knowledge(spark):
    at = datetime(2024, 1, 1)
    chunks = chunk_table(spark, [
        ("c0", "A", 0, 0, "k0", "Storage keeps rows in tables", [1.0, 0.0, 0.0]),
        ("c1", "B", 1, 0, "k1", "Memory has seven tiers", [0.0, 1.0, 0.0]),
    ])
    concepts = spark.createDataFrame([("k0", "Storage", "d"), ("k1", "Memory", "d")], "id string, name string, description string")
    edges = spark.createDataFrame(
        [("e0", "concept", "k0", "document", "A", "derived_from", at), ("e1", "concept", "k1", "document", "B", "derived_from", at)],
        "id string, source_type string, source_id string, target_type string, target_id string, relationship_type string, created_at timestamp",
    )
    projects = spark.createDataFrame([("p", "Plan", "text")], "id string, name string, description string")
    return ask.Knowledge(chunks, concepts, edges, projects, document_table(spark, ["A", "B"]))


def one_query(spark, text="what does storage keep", **more):
    row = {"query_id": "q", "query": text, "embedding": [1.0, 0.0, 0.0], "session_id": "s", "project_id": "p", "use_web": False,
           "asked_at": datetime(2024, 1, 2), **more}
    return spark.createDataFrame(
        [row], "query_id string, query string, embedding array<double>, session_id string, project_id string, use_web boolean, asked_at timestamp"
    )


def test_context_sections_and_budgets(spark):
    history = spark.createDataFrame([("s", 0, "user", "hello"), ("s", 1, "assistant", "hi")], "session_id string, turn long, role string, content string")
    full = ask.Evidence(one_query(spark), knowledge(spark), history)
    names = {r["name"]: r["content"] for r in full.packed.collect()}
    assert list(sorted(names)) == sorted(["system_policies", "current_message", "retrieved_knowledge", "dialogue_history", "concept_graph", "project_state"])
    assert names["dialogue_history"] == "user: hello\nassistant: hi"
    assert names["project_state"] == "Project: Plan\ntext"
    assert names["concept_graph"].startswith("concept:k0 --derived_from--> document:A")
    least = ask.Evidence(one_query(spark), knowledge(spark), history, max_tokens=1)
    assert {r["name"] for r in least.packed.collect()} == {"system_policies", "current_message"}


def test_turn_is_delivered_and_recorded(spark):
    evidence = ask.Evidence(one_query(spark), knowledge(spark))
    says = spark.createDataFrame([("q", "Tables, see [Title A]. However this is uncertain.")], "query_id string, response_text string")
    checked, ledger = ask.settle(one_query(spark), evidence, says)
    row = checked.first()
    assert row["delivered"] and row["all_violations"] == [] and row["failure_flags"] == []
    turn = ledger.turns.first()
    assert turn["state_path"][0] == "initialize" and len(turn["state_path"]) == 10
    assert [s["document_id"] for s in ledger.answers.first()["sources"]] == ["A", "B"]
    assert ledger.interactions.first()["content"].startswith("Q: what does storage keep\nA: Tables")


def test_withheld_turn_leaves_no_answer(spark):
    evidence = ask.Evidence(one_query(spark), knowledge(spark))
    says = spark.createDataFrame([("q", "See [Nowhere].")], "query_id string, response_text string")
    checked, ledger = ask.settle(one_query(spark), evidence, says)
    assert not checked.first()["delivered"]
    assert ledger.answers.count() == 0 and ledger.questions.count() == 1
    assert ledger.interactions.first()["content"].endswith("[not delivered -- failed validation/reflection]")


def test_clarification_skips_retrieval(spark):
    evidence = ask.Evidence(one_query(spark, "it"), knowledge(spark))
    nothing = spark.createDataFrame([], "query_id string, response_text string")
    _, ledger = ask.settle(one_query(spark, "it"), evidence, nothing)
    assert ledger.turns.first()["state_path"] == ["initialize", "interpret", "clarify", "respond", "persist", "terminate"]
    assert ledger.answers.first()["text"].startswith("Could you say a bit more")
    assert ledger.events.count() == 0


def test_two_part_research(spark):
    done = research.investigate(
        one_query(spark, "storage tables and memory tiers"),
        knowledge(spark),
        embed_parts=lambda parts: parts.drop("embedding").withColumn(
            "embedding", F.when(F.col("part") == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
        ),
    )
    assert [r["query"] for r in done.parts.orderBy("part").collect()] == ["storage tables", "memory tiers"]
    assert [r["document_id"] for r in done.references.orderBy("position").collect()] == ["A", "B"]
    assert done.comparisons.count() == 1
    written = spark.createDataFrame([("q", "Both hold [Title A] [Title B].")], "query_id string, response_text string")
    assert research.conclude(done, written).first()["delivered"]
