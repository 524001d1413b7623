"""Synchronous FTRL: a step over a table of samples is one plan of joins and sums.

All samples of a step see the same weights. For a coordinate with gradients g the step
sums up G = sum(g) and Q = sum(g * g), and

    z += G - (sqrt(n + Q) - sqrt(n)) / alpha * w,    n += Q

where w is the weight that n and z stood for before. This is not the order-dependent
result of one sample after another (plans.mixing), but it depends on no partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparseloom.functions.expressions import dot, ftrl_weight, ftrl_z, log_loss, sigmoid, vector_sum
from sparseloom.functions.params import Params
from sparseloom.operators.arrays import FieldRows, fm_gradient, numbers
from sparseloom.operators.blocks import block_gradients, block_logits
from sparseloom.operators.model import BIAS, Model, empty_model, initial_factors
from sparseloom.operators.score import by_feature, entries, ffm_crossed, ffm_rows, logits, valid, with_bias
from sparseloom.storage import materialize


def _zeros(k: int) -> Column:
    return F.array(*[F.lit(0.0)] * k)


def _factor_state(p: Params, *key: Column) -> dict[str, Column]:
    """n, z and v of joined factors; a coordinate without a row is met for the first time."""
    k = p.n_factors
    first = _zeros(k) if p.factor_init == "parity" else F.transform(initial_factors(p, *key), lambda w: ftrl_z(w, p))
    return {"n": F.coalesce("n", _zeros(k)), "z": F.coalesce("z", first)}


def _vector_weight(p: Params, n: str, z: str) -> Column:
    return F.zip_with(n, z, lambda a, b: ftrl_weight(a, b, p))


def linear_gradients(scored: DataFrame) -> DataFrame:
    """feat, g, q: summed gradients and squared gradients of linear weights and bias. scored: e and entries (structs with feat and value)."""
    g = F.col("e") * F.col("a.value")
    each = scored.select("e", F.explode("entries").alias("a")).select("a.feat", g.alias("g"))
    bias = scored.agg(F.sum("e").alias("g"), F.sum(F.col("e") * F.col("e")).alias("q")).filter(F.col("g").isNotNull())
    return each.groupBy("feat").agg(F.sum("g").alias("g"), F.sum(F.col("g") * F.col("g")).alias("q")).unionByName(bias.withColumn("feat", F.lit(BIAS)))


def _vector_gradients(scored: DataFrame, k: int, key: str, of: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Sums of the gradients that of makes of a batch: feat[, field], g, q."""
    each = scored.mapInArrow(lambda batches: map(of, batches), f"{key}, g array<double>, q array<double>")
    return each.groupBy(*each.columns[:-2]).agg(vector_sum(F.col("g"), k).alias("g"), vector_sum(F.col("q"), k).alias("q"))


def fm_gradients(scored: DataFrame, k: int) -> DataFrame:
    """feat, g, q (arrays). scored: e, s (sum of v * value by factor) and entries (feat, value, v)."""
    return _vector_gradients(scored.select("e", "s", "entries"), k, "feat int", lambda b: fm_gradient(numbers(b.column(0)), b.column(1), b.column(2), k))


def ffm_gradients(scored: DataFrame, k: int) -> DataFrame:
    """feat, field, g, q (arrays). scored: e, fields and entries, as ffm_rows makes them. Pairs are never formed (operators.arrays)."""
    return _vector_gradients(scored.select("e", "fields", "entries"), k, "feat int, field int", lambda b: FieldRows(b.column(1), b.column(2), k).gradients(numbers(b.column(0))))


def _updated_linear(model: Model, gradients: DataFrame, how: str) -> DataFrame:
    p = model.params
    n, z, g, q = (F.coalesce(c, F.lit(0.0)) for c in ("n", "z", "g", "q"))
    step = model.linear.select("feat", "n", "z").join(gradients, "feat", how).select("feat", n.alias("n"), z.alias("z"), g.alias("g"), q.alias("q"))
    w = ftrl_weight(F.col("n"), F.col("z"), p)
    step = step.select("feat", (F.col("n") + F.col("q")).alias("n"), (F.col("z") + F.col("g") - (F.sqrt(F.col("n") + F.col("q")) - F.sqrt("n")) / p.w_alpha * w).alias("z"))
    return step.select("feat", ftrl_weight(F.col("n"), F.col("z"), p).alias("w"), "n", "z")


def _updated_factors(model: Model, gradients: DataFrame, how: str) -> DataFrame:
    p, key = model.params, model.factor_key
    joined = model.factors.select(*key, "n", "z").join(gradients, key, how)
    state = _factor_state(p, *(F.col(c) for c in key))
    parts = F.arrays_zip(state["n"].alias("n"), state["z"].alias("z"), F.coalesce("g", _zeros(p.n_factors)).alias("g"), F.coalesce("q", _zeros(p.n_factors)).alias("q"))

    def moved(s: Column) -> Column:
        w = ftrl_weight(s.n, s.z, p)
        return F.struct((s.n + s.q).alias("n"), (s.z + s.g - (F.sqrt(s.n + s.q) - F.sqrt(s.n)) / p.w_alpha * w).alias("z"))

    new = joined.select(*key, F.transform(parts, moved).alias("m")).select(*key, F.col("m.n").alias("n"), F.col("m.z").alias("z"))
    return new.select(*key, _vector_weight(p, "n", "z").alias("v"), "n", "z")


def current(model: Model) -> tuple[DataFrame, DataFrame | None]:
    """Weights and factors that the sums stand for."""
    p = model.params
    linear = model.linear.select("feat", ftrl_weight(F.col("n"), F.col("z"), p).alias("w"))
    return linear, None if model.factors is None else model.factors.select(*model.factor_key, _vector_weight(p, "n", "z").alias("v"))


def first_factors(p: Params, *key: Column) -> Column:
    """Factors that a coordinate has when it is met for the first time."""
    if p.factor_init == "parity":
        return _zeros(p.n_factors)
    return F.transform(initial_factors(p, *key), lambda w: ftrl_weight(F.lit(0.0), ftrl_z(w, p), p))


def weights_by_feature(linear: DataFrame, factors: DataFrame | None, p: Params) -> DataFrame:
    """What entries meet: feat, w and v (FM) or blocks (FFM). The bias stays behind."""
    own = linear.filter(F.col("feat") != BIAS)
    return own.select("feat", "w") if factors is None else by_feature(own, factors, p.model_type == "FFM")


def scored_entries(met: DataFrame, linear: DataFrame, p: Params) -> DataFrame:
    """seq, y, logit and what gradients need of each sample: entries, and s (FM) or fields (FFM).

    met: entries that have met weights_by_feature; linear: where the bias is. They are put
    together by seq, and gradients need no join after that.
    """
    k, zero = p.n_factors, F.lit(0.0)
    if p.model_type == "FFM":
        rows = ffm_rows(met, zero, lambda feat, field: first_factors(p, feat, field))
        rows = rows.select("seq", "y", "fields", "entries", (F.col("linear") + ffm_crossed(k)).alias("sum"))
    else:
        fm = p.model_type == "FM"
        vx = [F.col("v")[i] * F.col("value") for i in range(k)]
        more = [F.array(*map(F.sum, vx)).alias("s"), F.sum(reduce(add, (c * c for c in vx))).alias("sq")] if fm else []
        if fm:
            met = met.withColumn("v", F.coalesce("v", first_factors(p, F.col("feat"))))
        entry = F.when(F.col("feat").isNotNull(), F.struct("feat", "value", *(["v"] if fm else [])))
        rows = met.groupBy("seq").agg(F.max("y").alias("y"), F.coalesce(F.sum(F.coalesce("w", zero) * F.col("value")), zero).alias("linear"), F.collect_list(entry).alias("entries"), *more)
        crossed = F.coalesce(0.5 * (dot(F.col("s"), F.col("s")) - F.col("sq")), zero) if fm else zero
        rows = rows.select("seq", "y", "entries", *(["s"] if fm else []), (F.col("linear") + crossed).alias("sum"))
    return with_bias(rows, linear, F.col("w")).withColumn("logit", F.col("bias") + F.col("sum")).drop("bias", "sum")


def scored_rows(samples: DataFrame, linear: DataFrame, factors: DataFrame | None, p: Params) -> DataFrame:
    """What scored_met says of samples. linear: feat, w; factors: feat[, field], v. Entries meet the model in one join, on feat."""
    return scored_met(samples, entries(samples, p.model_type == "FFM").join(weights_by_feature(linear, factors, p), "feat", "left"), linear, p)


def scored_met(samples: DataFrame, met: DataFrame, linear: DataFrame, p: Params) -> DataFrame:
    """scored_entries of samples whose entries have met a model.

    Without factors only sums come back by sample, and meet the entries that the samples
    hold anyway: lists of rows are sorted twice where Spark collects them for many keys.
    """
    if p.model_type != "LR":
        return scored_entries(met, linear, p)
    sums = met.groupBy(F.col("seq").alias("_seq")).agg(F.coalesce(F.sum(F.col("w") * F.col("value")), F.lit(0.0)).alias("sum"))
    held = F.transform("x", lambda e: F.struct(e.feat.alias("feat"), e.value.cast("double").alias("value")))
    rows = samples.select("seq", "y", held.alias("entries")).join(sums, F.col("seq").eqNullSafe(F.col("_seq"))).drop("_seq")
    return with_bias(rows, linear, F.col("w")).withColumn("logit", F.col("bias") + F.col("sum")).drop("bias", "sum")


@dataclass
class Step:
    """What a step does: new values of the coordinates that it touches, and the losses before it (seq, y, logit, loss)."""

    linear: DataFrame
    factors: DataFrame | None
    losses: DataFrame


def step_of(scored: DataFrame, model: Model, how: str = "right") -> Step:
    """The step that scored samples ask for. how='full' gives the whole new tables instead of what has changed."""
    p = model.params
    scored = materialize(scored.withColumn("e", sigmoid(F.col("logit")) - F.col("y")), "scored")  # losses and all gradients go on from here
    linear = _updated_linear(model, linear_gradients(scored), how)
    factors = None if model.factors is None else _updated_factors(model, (fm_gradients if p.model_type == "FM" else ffm_gradients)(scored, p.n_factors), how)
    return Step(linear, factors, scored.select("seq", "y", "logit", log_loss(F.col("y"), F.col("logit"), p.strict_loss).alias("loss")))


def linear_step(samples: DataFrame, model: Model, how: str = "right") -> Step:
    """The step of a linear model by blocks of samples (operators.blocks). how as in step_of."""
    p = model.params
    given = materialize(block_gradients(samples, current(model)[0], p), "scored")
    sums = given.filter(F.col("feat").isNotNull()).groupBy("feat").agg(F.sum("g").alias("g"), F.sum("q").alias("q"))
    losses = given.filter(F.col("feat").isNull()).select("seq", "y", "logit", log_loss(F.col("y"), F.col("logit"), p.strict_loss).alias("loss"))
    return Step(_updated_linear(model, sums, how), None, losses)


def batch_step(samples: DataFrame, model: Model) -> tuple[Model, DataFrame]:
    """The model after one step over all samples, and their losses before it: seq, y, logit, loss."""
    p = model.params
    if model.factors is None:
        step = linear_step(samples, model, "full")
    else:
        step = step_of(scored_rows(valid(samples, p), *current(model), p), model, "full")
    return Model(p, step.linear, step.factors), step.losses


def batch_changes(samples: DataFrame, model: Model) -> Step:
    """One step over all samples as what it changes. Of the model only what the samples touch is read on (and the bias), so a small step on a large model is small."""
    p = model.params
    if model.factors is None:
        return linear_step(samples, model)
    inside = valid(samples, p)
    touched = inside.select(F.explode(F.transform("x", lambda e: e.feat)).alias("feat")).union(inside.sparkSession.createDataFrame([(BIAS,)], "feat int")).distinct()
    own = replace(model, linear=model.linear.join(touched, "feat", "left_semi"), factors=model.factors.join(touched, "feat", "left_semi"))
    return step_of(scored_rows(inside, *current(own), p), own)


def held_logits(samples: DataFrame, model: Model) -> DataFrame:
    """seq, y, logit of samples that are kept in files, as they may be read several times."""
    return (block_logits if model.factors is None else logits)(samples, model)


def kept(model: Model) -> Model:
    """The model, read back from files: a step's plan doesn't grow with the steps before it."""
    return replace(model, linear=materialize(model.linear, "linear"), factors=None if model.factors is None else materialize(model.factors, "factors"))


def train_batch(samples: DataFrame, p: Params, start: Model | None = None) -> Model:
    """n_epochs steps over all samples."""
    model = start or empty_model(samples.sparkSession, p)
    for _ in range(p.n_epochs):
        model = kept(batch_step(samples, model)[0])
    return model
