import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparseloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives=10, low=30, high=90):
    kept = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a in kept:
        if not anchor(a[0]):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b) for b in kept if b != a), key=lambda r: r[:2])
        for s, i, _ in [r for r in scored if r[2][1] == a[1]][:positives]:
            found = [r for r in scored if r[2][1] != a[1] and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a[0], i, k, r[1], -s, -r[0]) for k, r in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"vec": F.lit(1), "len": F.lit(2), "grp": F.lit(3), "id": F.lit(4)})
    got = hn.hard_negatives(hn.prepare(df), F.col("id") % 100 == 0, **more)
    return sorted(tuple(r) for r in got.collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6), st.integers(-3000, 3000))
def test_no_row_that_reaches_theta_is_pruned(seed, n, width, theta):
    rng = np.random.default_rng(seed)
    vec = np.floor(rng.normal(size=(n, width)) * rng.choice([0, 1, 20, 50], (n, 1)))
    q = np.floor(rng.normal(size=width) * 30)
    found = set(hn.Lists(vec).candidates(q, float(theta)).tolist())
    assert {i for i in range(n) if vec[i] @ q >= theta} <= found


def test_ranges_prune():
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(500, 16))
    vec = np.floor(2560 * vec / np.linalg.norm(vec, axis=1)[:, None])
    q = vec[7]
    assert len(hn.Lists(vec).candidates(q, 2 * float(q @ q))) == 0
    assert len(hn.Lists(vec).candidates(q, 0.9 * float(q @ q))) < 50


def test_products_are_exact():
    a, b = np.array([[3.0e15, 7.0]]), np.array([2.0, 3.0])
    assert hn.products(a, b)[0] == 6 * 10**15 + 21
    assert hn.products(np.array([[2.0**31, 1.0]]), np.array([2.0**31, 1.0]))[0] == 2**62 + 1


def test_against_brute_force(spark):
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(420):
        c = rnd.randrange(4)
        rows.append((i * 10, [x + rnd.gauss(0, 0.6) for x in centres[c]], c if rnd.random() < 0.8 else rnd.randrange(4)))
    assert mined(spark, rows) == brute(rows) != []


def test_several_buckets_blocks_and_steps(spark, monkeypatch):
    """Tiny buckets, blocks and steps: the same result."""
    rnd = random.Random(5)
    rows = [(i * 20, [rnd.gauss(0.3, 1) * 2 ** rnd.randrange(3) for _ in range(5)], rnd.randrange(3)) for i in range(150)]
    for name, value in (("BUCKET", 4), ("BLOCK", 3), ("GROWTH", 3)):
        monkeypatch.setattr(hn, name, value)
    monkeypatch.setattr(hn.buckets, "__defaults__", (4, 3))
    assert mined(spark, rows) == brute(rows) != []


def test_hot_vector_and_ties(spark):
    """A third of the rows with one vector and label, others with it under another label, some of them anchors."""
    rows = [(i, [0.5, 0.25], 1) for i in range(0, 600, 10)] + [(i, [0.5, 0.25], 2) for i in range(5, 200, 10)] + [(i * 100 + 3, [0.4 * (i % 3), 0.1 * i], i % 3) for i in range(60)]
    assert mined(spark, rows) == brute(rows) != []


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.9, 0.5], 1), (100, None, 1), (200, [1.0, None], 1), (300, [1.0, nan], 1), (400, [1.0, inf], 1), (500, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (600, [], 1), (700, [0.0, 0.0], 2), (701, [0.5], 2), (702, [0.5, 0.2, 0.9], 1), (703, [-1.0, -1.0], 2), (800, [-0.001, 1e-9], 2), (801, [0.6, 0.3], 2), (802, [0.6, 0.3], 2), (900, [3.0], 3),
    ]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []
    empty = spark.createDataFrame([], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))
    assert hn.hard_negatives(hn.prepare(empty), F.col("id") % 100 == 0).count() == 0


def test_query_equals_sql_with_nulls(spark, tmp_path, same_rows):
    import duckdb

    rnd = random.Random(8)
    rows = [(i * 25 if i % 9 else i * 100, [rnd.gauss(0, 0.2) for _ in range(6)] if i % 11 else None, rnd.randrange(10) if i % 13 else None) for i in range(300)]
    rows += [(5000, [0.1, None, 0.2, 0.1, 0.0, 0.3], 2), (5100, [0.1, float("nan"), 0.2, 0.1, 0.0, 0.3], 2), (None, [0.1] * 6, 1)]
    spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same_rows(hn.op13_hard_negatives(spark, str(tmp_path)), con, hn.SQL)
