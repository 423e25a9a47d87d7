import pytest

from murmurlake.llm import queries as Q
from tests.conftest import DATA
from tests.helpers import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert spark_rows(Q.QUERIES[name](spark, DATA)) == sql_rows(duck, Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() >= 0
