"""Every registered query of the library against its SQL on the smallest given tables."""

import os

import pytest

from compare import rows, tables
from corpusloom.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_DIR).toPandas()
    if name not in catalog.SQL:
        assert len(got.columns)
        return
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_belongs_to_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
