"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from navscore.catalog import oracles, queries
from tests import compare

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not available")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_matches_sql(spark, duck, name):
    assert compare.difference(spark, duck, SF_DIR, name) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
