import pytest

from leafmill.plans import analytics as A


@pytest.fixture
def tables(spark, tmp_path):
    trials = [
        (1, "1-URGENT", 50.0),  # one trial: no variance
        (2, "1-URGENT", None), (2, "1-URGENT", None),  # none at all
        # variances 65703.125, 284.41125 and 571558050: halves at the seventh digit, exact ones to even, the other below its decimal
        (3, "2-HIGH", 1000.0), (3, "2-HIGH", 1362.5), (4, "2-HIGH", 1000.0), (4, "2-HIGH", 1023.85), (5, "2-HIGH", 1000.0), (5, "2-HIGH", 34810.0),
        # neither document nor priority is made up
        (6, None, 1.0), (None, "1-URGENT", 2.0), (None, None, 4.0),
        (7, "3-MEDIUM", 3.0), (7, "3-MEDIUM", 3.0), (8, "3-MEDIUM", float("nan")), (8, "3-MEDIUM", 1.0),
    ]
    o = [(i, d, "F", t, p) for i, (d, p, t) in enumerate(trials)]
    spark.createDataFrame(o, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    li = [(i, "A", "F", 1.0) for i in range(0, len(o), 2)]
    spark.createDataFrame(li, "l_orderkey long, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_text_of_a_variance_is_the_one_of_sql(spark, tables):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    # as they are, not as text: a null isn't the text "null"
    columns = ["document", "trials", "variance"]
    want = con.sql(f"SELECT {','.join(columns)} FROM ({A.oracle_sql()['trial_variance']})").fetchall()
    got = [tuple(r) for r in A.trial_variance(spark, tables).select(*columns).collect()]
    assert len(got) == len(want) and set(got) == set(want)
    assert {r[0]: r[1:] for r in got} == {
        "1-1-URGENT": (1, None), "2-1-URGENT": (0, None), "3-2-HIGH": (2, "6.570312e+04"), "4-2-HIGH": (2, "2.844112e+02"), "5-2-HIGH": (2, "5.715580e+08"),
        None: (3, "2.333330e+00"), "7-3-MEDIUM": (2, "0.000000e+00"), "8-3-MEDIUM": (2, "nan"),
    }
