"""Every registered query next to its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# All of them take minutes: ALL_QUERIES=1 python -m pytest tests/test_catalog.py
NAMES = sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else ["dedup_corpus", "hybrid_topk", "request_rate"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, line = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok, line
