"""Every registered query against its SQL at the smallest scale; the full check is ``oracle_check``."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 1
