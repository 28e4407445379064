"""Edges of all concepts, documents and projects, against the SQL twin and the selection."""

import probanda.catalog as catalog
from compare import connect, difference

SF = "/root/testdata/sf0.001"


def test_every_entity_gets_its_edges(spark):
    entry = catalog.REGISTRY["edges_of_every_entity"]
    rows = entry.run(spark, SF)
    assert difference(rows, connect(SF), entry.sql) is None
    every = {tuple(r) for r in rows.collect()}
    some = {tuple(r) for r in catalog.REGISTRY["edges_of_entities"].run(spark, SF).collect()}
    spark.catalog.clearCache()
    count = lambda found, kind: len({r[1] for r in found if r[0] == kind})
    assert some < every and count(every, "concept") >= 4 * count(some, "concept")
