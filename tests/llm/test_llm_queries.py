"""The optional queries on the smallest tables, against SQL where there is some."""

import oracle
import pytest
from helpers import SMALL

from tessellum.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert oracle.difference(queries.QUERIES[name](spark, SMALL), queries.SQL[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
