"""Every registered query against its SQL statement on the smallest tables."""

import os

import pytest

from compare import check, database
from spanwright.plans.registered import REGISTERED

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query(spark, con, name):
    ok, message, _ = check(spark, con, FOLDER, name, *REGISTERED[name])
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["doc_id", "cid", "text", "type", "start", "end", "assertions", "candidates"]
