"""Every query of the subpackage runs on the smallest tables and equals its SQL where it has one."""

import pytest
import verify
from orebody.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(FOLDER)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    ok, said = verify.compare(spark, con, name, queries.QUERIES[name], queries.SQL.get(name), FOLDER)
    assert ok, said
