"""The subpackage's queries: against their SQL where there is one, and each over whole tables."""

import pytest

from conftest import rows
from leafmill.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, duck, name):
    got = Q.queries()[name](spark, data).toPandas()
    assert len(got)
    if name in Q.oracle_sql():
        assert rows(got) == rows(duck.sql(Q.oracle_sql()[name]).df())


def test_columns(spark, data):
    want = {
        "p1_found": ["page_id", "line_no"], "p2_found": ["page_id", "line_no", "kind"], "p4_found": ["request_id", "page_id"], "p5_found": ["page_id_a", "page_id_b"], "p6_ids": ["doc_id", "ids"],
        "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
    }
    for name, columns in want.items():
        assert Q.queries()[name](spark, data).columns == columns
