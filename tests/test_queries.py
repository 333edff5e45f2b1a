"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import difference, oracle

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return oracle(FOLDER)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, con, name):
    assert difference(spark, con, FOLDER, name) is None


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
