import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from leafmill.session import session

    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="3g", spark_ui_showConsoleProgress="false")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    """A value as text, the same whichever engine it comes from."""
    if x is None:
        return "null"
    if isinstance(x, float):
        return "null" if x != x else f"{x:.6g}"
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return "[" + ",".join(map(plain, x)) + "]"
    return "null" if str(x) in ("NaT", "<NA>") else str(x)


def rows(df):
    """Rows of a pandas frame as sorted text, columns in order of their names."""
    df = df[sorted(df.columns)].astype(object)
    return sorted("|".join(map(plain, r)) for r in df.itertuples(index=False, name=None))
