import numpy as np
import pytest
from pyspark.sql import functions as F

from sparseloom.llm import quality_mil as q
from sparseloom.llm.words import WordHashes


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    x, counts, y = rng.normal(size=(9, q.FEATURES)) * 0.3, np.array([1, 5, 3]), np.array([1.0, 0.0, 1.0])
    net = q.fit(x, counts, y, rounds=1)
    loss = lambda: -np.mean(y * np.log(s := net.parts(x, counts)["score"]) + (1 - y) * np.log(1 - s))
    for name, g in net.gradients(x, counts, y).items():
        p = net.p[name] = np.array(net.p[name])
        at = tuple(int(i) for i in (rng.integers(0, n) for n in p.shape))
        was, eps = float(p[at]), 1e-5
        p[at] = was + eps
        high = loss()
        p[at] = was - eps
        low = loss()
        p[at] = was
        assert abs((high - low) / (2 * eps) - np.asarray(g)[at]) < 1e-6, name


def test_features_by_hand():
    text = "ONE two two ###\nthree 44 " + "four. " * 50
    features, counts = q.passages(["", text, "   "], WordHashes())
    assert counts.tolist() == [1, 2, 1] and (features[[0, 3]] == 0).all()
    first = features[1]
    words = text.split()[: q.PASSAGE]
    assert first[6] == pytest.approx(1 / q.PASSAGE) and first[8] == pytest.approx(1 / q.PASSAGE) and first[9] == pytest.approx(sum(w[-1] in ".,;:!?" for w in words) / q.PASSAGE)
    assert first[14] == pytest.approx(sum(a == b for a, b in zip(words[1:], words)) / q.PASSAGE)
    assert first[17] == pytest.approx((len(words) - len(set(words))) / q.PASSAGE)
    alone, _ = q.passages([text], WordHashes())
    assert np.allclose(alone, features[1:3])  # other texts of a batch don't matter


def test_attention_finds_the_passage():
    """Only one passage of many tells the label, and it gets the weight."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 9, 600)
    first = np.cumsum(counts) - counts
    noise = lambda n: np.where(np.arange(q.FEATURES) < 8, rng.normal(size=(n, q.FEATURES)), 0)
    x, y = noise(counts.sum()), (np.arange(600) % 3 > 0).astype(float)
    at = first + rng.integers(0, counts)
    x[at[y == 0], 4] += 6
    net = q.fit(x, counts, y, rounds=60)
    new = noise(80)
    new[np.arange(10) * 8 + 3, 4] += 6
    score, weight = net.attend(new, np.full(10, 8))
    assert (score < 0.5).all() and (weight.reshape(10, 8).argmax(1) == 3).mean() >= 0.8 and np.allclose(weight.reshape(10, 8).sum(1), 1)


def test_held_out(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = q.op11_quality_attention(spark, small)
    rows = got.join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    assert got.count() == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_fold_is_not_learned(spark, small):
    """Labels and languages of held-out rows, and of all rows their language and source, change nothing."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    fold = q.held_out(F.col("doc_id"))
    one = q.score(docs, q.train(docs, labels.filter(~fold)))
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    two = q.score(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), q.train(docs.repartition(3), turned.filter(~fold)))
    a, b = ({r["doc_id"]: r["score"] for r in x.collect()} for x in (one, two))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-5


def test_edges(spark, make_docs, edges):
    docs = make_docs(edges)
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 0), (6, 0), (6, 0), (7, 5), (99, 1)], "doc_id long, quality int")
    got = q.score(docs, q.train(docs, labels)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in edges) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["score"] == by[2]["score"] == by[3]["score"] and by[1]["n_passages"] == 1 and by[6]["n_passages"] == -(-20001 // q.PASSAGE)
    for nothing in (labels.limit(0), labels.filter("quality = 1")):  # no labels, or one kind
        flat = {r["score"] for r in q.score(docs, q.train(docs, nothing)).collect()}
        assert len(flat) == 1
    assert q.score(docs.limit(0), q.train(docs.limit(0), labels)).count() == 0


def test_sample_bounds(spark, make_docs):
    """Bounds hold where one id is labelled often and held by many rows."""
    docs = make_docs([(1, f"text {i} of one id " * 40) for i in range(60)] + [(i, "other text") for i in range(2, 30)])
    labels = spark.createDataFrame([(1, i % 2) for i in range(40)] + [(i, 1) for i in range(2, 30)], "doc_id long, quality int")
    seen = []
    real, q.fit = q.fit, lambda f, c, y: seen.append((f.shape, c.max())) or real(f, c, y, rounds=1)
    try:
        q.train(docs, labels, sample_rows=20, sample_passages=2)
    finally:
        q.fit = real
    assert seen[0][0][0] <= 40 and seen[0][1] <= 2
