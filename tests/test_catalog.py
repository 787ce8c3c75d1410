"""Every registered query against its SQL counterpart, and what its plan must not contain."""

import pytest
from conftest import plan

from workload.catalog import QUERIES
from workload.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees_with_sql(spark, con, name):
    found = compare(spark, con, SF, name)
    assert found["ok"], found["note"]
    assert found["rows"] > 0


# Names of queries that run without Python.
NATIVE = """fix_encoding drop_furniture_lines normalize_whitespace strip_control strip_ends strip_urls
strip_emails collapse_punctuation sections chunk_estimate fixed_windows page_assembly corpus_scan
category_filter source_filter combined_filter unknown_categories category_descriptions
nearest_to_one packed_entries packed_context source_lists messages plain_prompts
system_user_messages excerpts clipped_excerpts request_validation collection_stats""".split()


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_have_no_python_node(spark, name):
    text = plan(QUERIES[name][0](spark, SF))
    assert "Python" not in text and "InArrow" not in text


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in (
    "rebuilt_collection", "ingest_report", "stored_ordinals", "appended_documents",
    "appended_ordinals")])
def test_no_query_pairs_rows_blindly(spark, name):
    text = plan(QUERIES[name][0](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_chunking_is_computed_once(spark):
    text = plan(QUERIES["processed_documents"][0](spark, SF))
    assert text.count("[_nfkc(") == 1 and text.count("ArrowEvalPython [split(") == 1


def test_entry(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
