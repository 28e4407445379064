"""Registered queries against their SQL twins on the smallest tables.

The whole list takes many minutes; ALL_QUERIES=1 runs it, otherwise one query of each
kind is checked.  ``python tests/compare.py sf0.01 [name …]`` prints differences.
"""

import os

import pytest

import probanda.catalog as catalog
from compare import connect, difference

SF = "/root/testdata/sf0.001"
QUICK = (
    "clean_text tokenize chunk_text decompose_question detect_injection intent_features validate_uploads "
    "integrity_report current_settings embed_only_new cosine_similarity hybrid_search "
    "sub_question_search context_packing_tight validation_verdicts turn_memory session_summaries "
    "remember admission_limit stage_latency event_fan_out live_stage_status "
    "failed_turns admitted_texts entity_integrity edge_text ingest_events vector_top_k keyword_top_k "
    "decode_chunk_rows upload_files"
).split()
NAMES = list(catalog.REGISTRY) if os.environ.get("ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    entry = catalog.REGISTRY[name]
    found = difference(entry.run(spark, SF), con, entry.sql)
    spark.catalog.clearCache()
    assert found is None, found


def test_every_query_has_a_twin():
    assert [n for n, e in catalog.REGISTRY.items() if e.sql is None] == []
