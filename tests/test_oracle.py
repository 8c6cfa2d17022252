"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import checks

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return checks.connect(FOLDER)


def test_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    checks.compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
