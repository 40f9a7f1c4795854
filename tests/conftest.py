import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    where = tempfile.mkdtemp(prefix="weftline-test-")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{where}/checkpoint", "spark.sql.warehouse.dir": f"{where}/warehouse",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    """The smallest driver tables; tests that need them are skipped where they are absent."""
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


def _rows(frame):
    """Rows of a pandas frame as comparable text, columns by name, floats to 6 digits."""
    import pandas

    def text(x):
        if x is None or x is pandas.NA or x != x:
            return "null"
        if hasattr(x, "item"):
            x = x.item()
        return f"{x + 0.0:.6g}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(text, row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(found, expected):
        (a, x), (b, y) = _rows(found), _rows(expected)
        assert a == b
        assert len(x) == len(y)
        assert [p for p in zip(x, y, strict=True) if p[0] != p[1]][:3] == []

    return check


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over Parquet tables of a folder, or over pandas frames given by name."""
    import duckdb

    def run(sql, folder=None, **tables):
        con = duckdb.connect()
        for name in sorted(os.listdir(folder)) if folder else ():
            con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
        for name, table in tables.items():
            con.register(name, table)
        return con.sql(sql).df()

    return run
