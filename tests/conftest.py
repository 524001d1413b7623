import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparseloom.session import build_session

    session = build_session("tests", "local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Whether a Spark result and a DuckDB query have the same columns and rows, in any order."""

    def compare(df, con, sql):
        got, want = df.toPandas(), con.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda x: sorted(tuple(map(str, r)) for r in x[columns].itertuples(index=False))
        assert rows(got) == rows(want)

    return compare
