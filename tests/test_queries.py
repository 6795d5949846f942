"""Every registered query runs, and gives what its SQL gives."""

import os

import __spark_entry__ as entry_point
import pytest
from oracle_check import differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["doc_id", "x", "y", "oov_cnt", "oov"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], SF_DIR) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) > 0
