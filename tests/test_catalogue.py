"""Every query against its SQL."""

import pytest
from conftest import DATA

from spindrift.plans.catalogue import QUERIES, SQL


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, same_rows, name):
    same_rows(QUERIES[name](spark, DATA), SQL[name])
