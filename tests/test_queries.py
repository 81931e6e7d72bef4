"""Every registered query against its SQL, and the shape of what the checks read."""

import os
import sys

import pytest
from conftest import ROOT

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entries  # noqa: E402
from check_queries import compare  # noqa: E402

from bucketscope.catalog import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    same, note = compare(spark, SF_DIR, name)
    assert same, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entries.queries()) and set(ORACLES) <= set(entries.oracle_sql())


def test_entry(spark):
    listed = entries.entry(spark).collect()
    assert {r["entry_type"] for r in listed} == {"PREFIX"} or len(listed) > 0
    assert [r["key"] for r in listed] == sorted(r["key"] for r in listed)
