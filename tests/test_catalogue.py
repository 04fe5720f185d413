"""Every query with an SQL twin agrees with it on the smallest data."""

import os

import pytest

from corvane.plans import catalogue

from .oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    assert differences(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name]) == []


@needs_data
def test_chunk_source_covers_the_lines(spark):
    rows = catalogue.queries()["chunk_source"](spark, SF).collect()
    assert {"code_chunk", "document"} <= {r.level for r in rows}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
