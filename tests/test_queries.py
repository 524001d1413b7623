"""Every query that SQL can say, against DuckDB; the others run."""

import pytest

from sparseloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, small, duck, same_rows):
    same_rows(queries.QUERIES[name](spark, small), duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(name, spark, small):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["feat", "w", "n", "z"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
