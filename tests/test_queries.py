import os

import pytest

import __spark_entry__ as registered
from suite.oracle import ORACLE
from suite.queries import REGISTRY
from tests import compare

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


def test_every_query_has_its_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(registered.oracle_sql()) <= set(registered.queries())


@needs_data
def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["source", "start_time", "end_time", "duration_seconds", "severity", "start_line", "end_line"]
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_its_sql(spark, name):
    _, only_spark, only_sql, unequal_types, *_ = compare.check(spark, SF_DIR, name)
    assert (only_spark[:3], only_sql[:3], unequal_types) == ([], [], [])
