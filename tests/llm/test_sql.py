"""Operators that SQL can say, against DuckDB, on the small tables and on awkward rows."""

import pytest

from sparseloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, small, duck, same_rows):
    same_rows(queries.QUERIES[name](spark, small), duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op13_hard_negatives"}))
def test_awkward_rows(name, spark, make_docs, edges, same_rows, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in dict.fromkeys(edges) if i is not None]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op9_html_text"}))
def test_empty_tables(name, spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    for table, schema in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op9_html_text", "op3_jaccard_join", "op12_collocations", "op13_hard_negatives"}))
def test_a_row_for_each_row(name, spark, make_docs, edges, tmp_path):
    """Nulls, repeated rows and clashing columns: as many rows as given, equal rows with equal results."""
    make_docs(edges).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "One."), (None, "x"), (2, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in edges)
    drop = {"start"}  # op1 counts on
    twice = [{k: v for k, v in r.asDict().items() if k not in drop} for r in got if r["doc_id"] == 5]
    assert twice[0] == twice[1]
