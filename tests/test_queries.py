"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

from tools.check import compare, oracle
from workload import ORACLES, QUERIES

FOLDER = os.environ.get("ATTEST_TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    state, _, _, note = compare(spark, sql, FOLDER, name)
    assert state == "ok", note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
