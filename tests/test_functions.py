import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparseloom.functions.expressions import ftrl_weight, ftrl_z, hash_gaussian, log_loss, number_text, sgn, sigmoid
from sparseloom.functions.metrics import mean_loss
from sparseloom.functions.params import Params, flag, parse_options


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_sgn_and_sigmoid(spark):
    got = values(spark, [(1.0,), (0.0,), (-2.0,)], "x double", sgn(F.col("x")), sigmoid(F.col("x")))
    assert [g[0] for g in got] == [1, -1, -1]
    assert [g[1] for g in got] == pytest.approx([0.7311, 0.5, 0.1192], abs=1e-4)


def test_log_loss(spark):
    rows = [(1, 2.0), (0, 1.0), (1, 40.0), (0, 40.0), (0, -800.0), (1, -800.0)]
    got = [r[0] for r in values(spark, rows, "y int, l double", log_loss(F.col("y"), F.col("l")))]
    assert got == pytest.approx([0.1269, 1.3133, 0, 40, 0, 800], abs=1e-4)
    strict = [r[0] for r in values(spark, rows, "y int, l double", log_loss(F.col("y"), F.col("l"), strict=True))]
    assert strict[:2] == pytest.approx([0.1269, 1.3133], abs=1e-4)
    assert math.isnan(strict[2]) and strict[3] == math.inf and math.isnan(strict[4]) and strict[5] == math.inf


def test_mean_loss_of_nothing_is_nan(spark):
    row = mean_loss(spark.createDataFrame([], "y int, logit double")).first()
    assert math.isnan(row["loss"]) and row["n"] == 0


def test_weight_of_z_and_back(spark):
    p = Params(model_type="LR")
    got = values(spark, [(0.5,), (-0.25,), (0.0,)], "w double", ftrl_weight(F.lit(0.0), ftrl_z(F.col("w"), p), p))
    assert [g[0] for g in got] == pytest.approx([0.5, -0.25, 0.0])
    assert values(spark, [(0.1,), (-0.1,), (0.11,)], "z double", ftrl_weight(F.lit(0.0), F.col("z"), p) == 0) == [(True,), (True,), (False,)]


def test_gaussian_is_fixed_by_its_key(spark):
    df = spark.range(20000).withColumn("g", hash_gaussian(1.0, 0.5, 3, "id"))
    mean, std = df.agg(F.avg("g"), F.stddev("g")).first()
    assert mean == pytest.approx(1.0, abs=0.02) and std == pytest.approx(0.5, abs=0.02)
    assert df.repartition(7).agg(F.sum(F.round("g", 9))).first()[0] == pytest.approx(df.agg(F.sum(F.round("g", 9))).first()[0])


def test_number_text(spark):
    rows = [(0.0001,), (0.12345,), (1.0,), (0.0,), (2.5,), (1234567.0,)]
    assert [r[0] for r in values(spark, rows, "x double", number_text(F.col("x")))] == ["0.0001", "0.1234", "1.0", "0.0", "2.5", "1234567.0"]


def test_options():
    p = parse_options(["--model_type", "lr", "--n_epochs", "3", "--online", "false", "--w_alpha", "0.1"])
    assert (p.model_type, p.n_epochs, p.online, p.w_alpha) == ("LR", 3, False, 0.1)
    with pytest.raises(SystemExit):
        parse_options(["--no_such", "1"])
    for bad in ({"model_type": "GBM"}, {"n_epochs": 0}, {"factor_init": "cold"}, {"w_alpha": 0.0}):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(ValueError):
        Params(model_type="FFM").check_format("libsvm")


@settings(max_examples=20, deadline=None)
@given(st.sampled_from(["yes", "TRUE", "y", "1", "no", "False", "n", "0"]))
def test_flag(word):
    assert flag(word) == (word.lower() in ("yes", "true", "y", "1"))


def test_number_text_of_whole_numbers(spark):
    """Whole numbers have a way of their own, within what a long holds; the text is that of other numbers."""
    rows = [(1.0,), (25.0,), (999999999.0,), (1e9,), (1e20,), (-1.0,), (-0.0,), (float("nan"),), (None,)]
    for kind in ("float", "double"):
        text = [r[0] for r in values(spark, rows, f"x {kind}", number_text(F.col("x")))]
        assert text == ["1.0", "25.0", "1000000000.0" if kind == "float" else "999999999.0", "1000000000.0", "100000002004087730000.0" if kind == "float" else "100000000000000000000.0", "-1.0", "0.0", "NaN", "null"]
