import hashlib

import corpus_pipeline
from sparseloom.llm.common import materialize
from tests.llm.test_jaccard_join import brute as brute_groups
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_tokens import as_ids


def test_stages(spark, small):
    """Each stage on what the one before kept, against brute force."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    seen = [rows(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, small), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append(rows(docs))
    given, known, lines, single, clean = seen
    assert known == [(i, t) for i, t in given if t and any(map(str.isalpha, t))]
    assert lines == sorted((int(i), t) for i, t, _, _ in brute_lines(known))
    groups = brute_groups(lines)
    assert single == [(i, t) for i, t in lines if groups[i][0] == i]
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaked = {i for i, t in single if any(s in " ".join(t.split()) for s in items)}
    assert {i for i, _ in single} - {i for i, _ in clean} >= leaked and len(single) - len(clean) <= len(leaked) + 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in out.collect()) == [(i, hashlib.sha256(as_ids(t)).hexdigest()) for i, t in clean]


def test_run(spark, make_docs, edges, tmp_path):
    make_docs([*edges, (60, "Texts with a letter stay")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "One.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert 60 in {r["doc_id"] for r in got.collect()}


def test_rows_with_shared_or_missing_ids(spark, make_docs, tmp_path):
    """Rows of one id and different texts, and rows without an id, are documents of their own; a near copy with an id is kept before one without."""
    text = lambda k: f"clean text number {k} " + " ".join(f"w{k}x{i}" for i in range(30))
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(1, text(1)), (1, text(2)), (None, text(3)), (None, text(1)), (None, "x " + item), (4, text(4)), (4, text(4)), (5, text(4)), (3, "y " + item)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[2:4]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
    got = sorted((str(r["doc_id"]), r["text"]) for r in docs.collect())
    assert got == sorted([("1", text(1)), ("1", text(2)), ("None", text(3)), ("4", text(4))])
    assert corpus_pipeline.keep_one_of_each_group(spark, make_docs([(1, None), (2, ""), (None, " ")]), str(tmp_path)).count() == 1
