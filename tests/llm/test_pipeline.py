"""The pipeline against brute force, stage by stage on what the stage before kept."""

import pytest
from helpers import awkward, empty, written
from test_decontaminate import brute as brute_hits
from test_pii import brute as brute_spans
from test_simhash import brute_components, brute_print

import corpus_pipeline
from probanda.llm import quality
from probanda.llm.common import stored, table
from probanda.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def masked(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute_spans(text)))
    out, at, open_until = "", 0, -1
    merged = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += text[at:a] + f"[{k.upper()}]"
        at = b
    return out + text[at:]


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    before = rows(docs)
    kept = stored(stage[names[0]](spark, docs, SF), "t")
    scored = {r.doc_id: r.predicted for r in quality.report(docs, table(spark, SF, "labels")).collect()}
    after = rows(kept)
    assert kept.columns == columns and set(after) == {i for i in before if scored[i] == 1}
    unique = stored(stage[names[1]](spark, kept, SF), "t")
    classes = brute_components([(i, brute_print(r.text)) for i, r in after.items()])
    assert unique.columns == columns and rows(unique) == {i: r for i, r in after.items() if classes[i] == i}
    clean = stored(stage[names[2]](spark, unique, SF), "t")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    short = [(i, r.text) for i, r in rows(unique).items() if len(r.text) < 3000]
    hits = brute_hits(short, items)
    left = rows(clean)
    assert clean.columns == columns and all((i in left) == (not hits[i][4]) for i, _ in short)
    private = stored(stage[names[3]](spark, clean, SF), "t")
    assert private.columns == columns
    for i, r in rows(private).items():
        assert r.text == masked(left[i].text) and r.n_chars == (len(r.text) if r.text != left[i].text else left[i].n_chars)
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    tokens = rows(stage[names[4]](spark, private, SF))
    assert all(r.round_trip for r in tokens.values())
    assert all(r.ids == library.encode(r.text, add_special_tokens=False).ids for r in tokens.values())
    assert rows(corpus_pipeline.run(spark, SF)) == tokens


def test_awkward_rows(spark):
    docs = awkward(spark).withColumnRenamed("ids", "ids2")
    folder = written(docs, "documents")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "ids", "round_trip"]
    # blank texts are one group, the five copies another
    assert sorted(r.doc_id for r in out.collect()) in ([1, 4, 5, 7], [1, 5, 7])
    bare = written(empty(spark), "documents")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{bare}/{name}.parquet")
    assert corpus_pipeline.run(spark, bare).collect() == []
