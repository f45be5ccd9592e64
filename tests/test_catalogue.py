"""Every registered query beside its SQL twin on the smallest data folder."""

import os

import pytest

from check import compare, connect
from textloom.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, FOLDER, name, con) is None


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
