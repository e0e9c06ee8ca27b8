"""The queries that SQL can express, beside it, on the smallest data."""

import os

import pytest

from folioscope.llm import queries
from tests import oracle

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(queries.SQL) == {"op8_url_filter", "op9_source_mix", "op11_filter_audit", "op12_centroid_clusters", "op13_chat_format"} and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    assert oracle.compare(spark, oracle.connect(SF), name, queries.QUERIES[name], queries.SQL[name], SF) == ""
