import zlib

from helpers import awkward, empty

from probanda.llm import quality
from probanda.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    good, bad = [i for i in held if labels[i] == 1], [i for i in held if labels[i] == 0]
    assert sum(got[i].predicted for i in good) >= 0.97 * len(good)
    assert sum(1 - got[i].predicted for i in bad) >= 0.9 * len(bad)


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    spoilt = labels.withColumn("quality", labels["quality"] * 0).where(quality.held_out()).union(labels.where(~quality.held_out()).select(labels.columns))
    a, b = quality.fit(docs, labels), quality.fit(docs, spoilt)
    assert (a.labels == b.labels).all() and (a.vectors == b.vectors).all()


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (4, 1, 0), (1, None, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == model.prior for r in rows if not (r.text or "").strip())
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.report(empty(spark), labels).collect() == []
