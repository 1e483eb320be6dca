"""Every query of the core library against its SQL on the smallest tables."""

import oracle
import pytest
from helpers import SMALL

from tessellum.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_sql_has_its_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert oracle.difference(QUERIES[name](spark, SMALL), SQL[name], SMALL) == ""


NO_ROWS = {"first_list_links"}  # the test tables hold no list with a link; tests/test_operators.py has some


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns
    assert (df.count() == 0) == (name in NO_ROWS)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
