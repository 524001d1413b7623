import pytest
from pyspark.sql import functions as F

from sparseloom.functions.params import Params
from sparseloom.operators import sparse_model
from sparseloom.operators.model import BIAS, LINEAR, Model, empty_model
from sparseloom.operators.score import logits
from sparseloom.operators.sparse_model import meeting_entries, passes, sparse_linear, sparse_logits

FEATS = 3000
SAMPLES = "seq long, y int, x array<struct<field: int, feat: int, value: float>>"


def params(**more):
    return Params(**({"model_type": "LR", "n_feats": FEATS, "n_fields": 4, "init_mean": 0.1} | more))


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(i, i % 2, [(k, (i * 7 + k * k * 131) % (FEATS + 50), 0.5 + k) for k in range(i % 5)]) for i in range(2000)]
    rows += [(5000, 1, []), (5001, 0, None), (5002, 1, [(0, 4, 1.0), (0, 4, 2.0), (1, 5, 0.0)])]
    return spark.createDataFrame(rows, SAMPLES).cache()


def model(spark, zeros, more=()):
    """Two of three features are touched; zeros of ten of them have weight 0."""
    rows = [(f, 0.0 if f * 17 % 10 < zeros else f / 1000 - 1, 1.0, 0.5) for f in range(FEATS) if f % 3] + list(more)
    return Model(params(), spark.createDataFrame(rows, LINEAR))


def scores(df):
    return {r["seq"]: (r["y"], r["logit"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, (y, logit) in want.items():
        assert got[k] == (y, pytest.approx(logit, abs=1e-12))


@pytest.mark.parametrize("bits", [23, 10])
def test_equal_to_the_whole_model(spark, samples, monkeypatch, bits):
    """With filters that let half of everything pass by chance too."""
    monkeypatch.setattr(sparse_model, "MOST_BITS", bits)
    m = model(spark, 8, [(BIAS, 0.25, 1.0, 1.0)])
    sparse = sparse_linear(m)
    same(scores(sparse_logits(samples, sparse)), scores(logits(samples, m)))
    extra = sparse.weights.filter(F.col("feat") % 3 == 0).count()
    assert extra > 500 if bits == 10 else extra < 20


@pytest.mark.parametrize("given", ["empty", "zeros", "no_samples"])
def test_ends(spark, samples, given):
    m = empty_model(spark, params()) if given == "empty" else model(spark, 10)
    some = samples.limit(0) if given == "no_samples" else samples
    same(scores(sparse_logits(some, sparse_linear(m))), scores(logits(some, m)))


def test_rows_fall_with_zeros(spark, samples):
    """Entries of zero and of untouched weights leave the join, and so do zeros."""
    whole = samples.select(F.explode("x.feat").alias("feat"))
    for zeros in (0, 5, 9):
        m = model(spark, zeros)
        sparse = sparse_linear(m)
        left = m.linear.filter("w != 0").select("feat")
        needed, met = whole.join(left, "feat", "left_semi").count(), meeting_entries(samples, sparse).count()
        assert needed <= met <= needed + 0.01 * whole.count()
        assert left.count() <= sparse.weights.count() <= left.count() + 0.01 * FEATS


def test_no_member_is_missed(spark):
    feats = spark.range(5000).selectExpr("cast(id * 37 as int) AS feat")
    marked = feats.crossJoin(sparse_model.coordinate_filter(feats, "words"))
    assert marked.filter(~passes(F.col("feat"), F.col("words"))).count() == 0
    others = feats.selectExpr("-feat - 1 AS feat").crossJoin(sparse_model.coordinate_filter(feats, "words"))
    assert others.filter(passes(F.col("feat"), F.col("words"))).count() < 100


def test_filters_stay_within_a_stage(spark, samples):
    """No exchange carries them."""
    plan = sparse_logits(samples, sparse_linear(model(spark, 5)))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert moved and not any("touched" in line or "kept" in line for line in moved)
    assert "Generate explode(x" in plan and "explode(filter" not in plan
