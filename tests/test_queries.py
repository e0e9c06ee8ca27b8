"""Every registered query beside its SQL, where it has one, on the smallest data; the driver
does the same on larger data."""

import os

import pytest

from tests import oracle

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# Queries that say a lot quickly; set CHECK_ALL=1 to run every one.
QUICK = ("t12_chunk_text", "t13_page_anchors", "l8_record_version", "l9_change_note", "l13_revert_plan", "r2_top_passages_in_blocks",
         "r3_search_pinned_libraries", "c2_linked_citations", "c8_references", "c10_citation_forms", "e1_run_metrics", "e11_latency_table", "e13_sequence",
         "w8_robots_decision", "w19_halted_crawls", "m7_next_speakers", "m10_segments", "s9_case_law_documents", "a1_first_access", "x2_running_metrics")


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__
    return __spark_entry__


def test_contract(entry):
    names, sql = entry.queries(), entry.oracle_sql()
    assert len(names) > 200 and set(sql) <= set(names)


def test_flagship(entry, spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "document_id", "corpus", "version", "similarity"] and df.count() > 0


def _names():
    if os.environ.get("CHECK_ALL") != "1":
        return QUICK
    import __spark_entry__
    return sorted(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query(entry, spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    con = oracle.connect(SF)
    assert oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""
