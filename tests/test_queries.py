"""Every query against its SQL on the smallest tables; those without SQL must run."""

import pytest

import __spark_entry__ as entry
from conftest import rows
from leafmill.session import tidy, written_tables

CORE = [m for m in entry._modules() if m.__name__.startswith("leafmill.plans")]
QUERIES = {n: q for m in CORE for n, q in m.queries().items()}
SQL = {n: s for m in CORE for n, s in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    before = written_tables(spark)
    with tidy(spark):
        got = QUERIES[name](spark, data).toPandas()
    assert written_tables(spark) == before
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_has_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
