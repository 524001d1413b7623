"""Scores of samples: entries meet weights in joins on the feature, sums come back by sample."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparseloom.functions.expressions import dot, sigmoid, vector_sum
from sparseloom.operators.arrays import FieldRows
from sparseloom.operators.filters import in_range
from sparseloom.operators.model import BIAS, Model, initial_factors, initial_weight


def valid(samples: DataFrame, p) -> DataFrame:
    """Samples without entries beyond the model's features (and fields, for an FFM)."""
    return samples.withColumn("x", in_range(F.col("x"), p.n_feats, p.n_fields if p.model_type == "FFM" else None))


def entries(samples: DataFrame, with_fields: bool = False) -> DataFrame:
    """seq, y, field, feat, value: a row for each entry, and one of nulls for a sample without entries, so sums by seq need no second look at the samples. with_fields adds fields, those that the sample has."""
    fields = [F.array_distinct(F.transform("x", lambda e: e.field)).alias("fields")] * with_fields
    each = samples.select("seq", "y", *fields, F.explode_outer("x").alias("e"))
    return each.select("seq", "y", *["fields"] * with_fields, "e.field", "e.feat", F.col("e.value").cast("double").alias("value"))


def with_bias(sums: DataFrame, linear: DataFrame, weight: Column) -> DataFrame:
    """sums (one row for each sample) with the bias, from the one row of linear that has it; 0 without one."""
    bias = linear.filter(F.col("feat") == BIAS).agg(F.coalesce(F.max(weight), F.lit(0.0)).alias("bias"))
    return sums.crossJoin(F.broadcast(bias))  # one row


def linear_sums(samples: DataFrame, model: Model) -> DataFrame:
    """seq, y, linear: bias and weighted sum of the entries. A feature of most samples is a key that adaptive execution splits, as the sums go on by sample."""
    w = F.coalesce("w", initial_weight(model.params, F.col("feat")))
    sums = entries(samples).join(model.linear.select("feat", "w"), "feat", "left").groupBy("seq").agg(F.max("y").alias("y"), F.sum(w * F.col("value")).alias("s"))
    return with_bias(sums, model.linear, F.col("w")).select("seq", "y", (F.col("bias") + F.coalesce("s", F.lit(0.0))).alias("linear"))


def fm_logits(samples: DataFrame, model: Model) -> DataFrame:
    """seq, y, logit. Pairs are never formed: half of squared sums less sums of squares, factor by factor, in the same pass as the linear part."""
    p, k = model.params, model.params.n_factors
    joined = entries(samples).join(model.linear.select("feat", "w"), "feat", "left").join(model.factors.select("feat", "v"), "feat", "left")
    w = F.coalesce("w", initial_weight(p, F.col("feat")))
    v = F.coalesce("v", initial_factors(p, F.col("feat")))
    joined = joined.select("seq", "y", (w * F.col("value")).alias("wx"), v.alias("v"), "value").withColumn("vx", F.transform("v", lambda e: e * F.col("value")))
    sums = joined.groupBy("seq").agg(F.max("y").alias("y"), F.sum("wx").alias("linear"), vector_sum(F.col("vx"), k).alias("s"), F.sum(dot(F.col("vx"), F.col("vx"))).alias("q"))
    crossed = F.coalesce(F.col("linear") + 0.5 * (dot(F.col("s"), F.col("s")) - F.col("q")), F.lit(0.0))
    return with_bias(sums, model.linear, F.col("w")).select("seq", "y", (F.col("bias") + crossed).alias("logit"))


def by_feature(linear: DataFrame, factors: DataFrame, per_field: bool) -> DataFrame:
    """feat, w and v (an FM's factors) or blocks (an FFM's, by field): weights and factors of a feature in one row, so that entries meet a model once.

    A feature has at most as many blocks as there are fields. The rows get an exchange of
    their own for the join with entries, so adaptive execution can split a hot feature.
    """
    none = F.lit(None)
    given = linear.select("feat", "w", none.cast("int").alias("field"), none.cast("array<double>").alias("v"))
    both = given.unionByName(factors.select("feat", none.cast("double").alias("w"), F.col("field") if per_field else none.cast("int").alias("field"), "v"))
    held = F.map_from_entries(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("field", "v")))).alias("blocks") if per_field else F.max("v").alias("v")
    return both.groupBy("feat").agg(F.max("w").alias("w"), held).withColumn("feat", F.bitwise_not(F.bitwise_not("feat")))


def ffm_rows(met: DataFrame, w: Column, v) -> DataFrame:
    """seq, y, linear (without the bias), fields and entries of each sample: an entry is (feat, field, value, vx), vx[j] its factors for field j times its value.

    met: entries with their fields and what they have met of a model, w and blocks. A
    sample of m entries is m rows, and pairs are never formed. w and v(feat, field) are
    what entries have that met nothing.
    """
    vx = F.transform("fields", lambda g: F.transform(F.coalesce(F.try_element_at("blocks", g), v(F.col("feat"), g)), lambda c: c * F.col("value")))
    entry = F.when(F.col("feat").isNotNull(), F.struct("feat", "field", "value", vx.alias("vx")))
    return met.groupBy("seq").agg(F.max("y").alias("y"), F.first("fields").alias("fields"), F.coalesce(F.sum(F.coalesce("w", w) * F.col("value")), F.lit(0.0)).alias("linear"), F.collect_list(entry).alias("entries"))


def ffm_crossed(k: int) -> Column:
    """The sum over pairs of entries, from fields and entries, for the samples of an Arrow batch at once."""
    return F.arrow_udf(lambda fields, entries: pa.array(FieldRows(fields, entries, k).crossed()), "double")("fields", "entries")


def ffm_logits(samples: DataFrame, model: Model) -> DataFrame:
    p = model.params
    weights = by_feature(model.linear.filter(F.col("feat") != BIAS), model.factors, True)
    rows = ffm_rows(entries(samples, True).join(weights, "feat", "left"), initial_weight(p, F.col("feat")), lambda feat, field: initial_factors(p, feat, field))
    rows = rows.select("seq", "y", (F.col("linear") + ffm_crossed(p.n_factors)).alias("sum"))
    return with_bias(rows, model.linear, F.col("w")).select("seq", "y", (F.col("bias") + F.col("sum")).alias("logit"))


def logits(samples: DataFrame, model: Model) -> DataFrame:
    """seq, y, logit: a row for each sample, those without entries too. seq tells samples apart."""
    inside = valid(samples, model.params)
    if model.params.model_type == "LR":
        return linear_sums(inside, model).withColumnRenamed("linear", "logit")
    return (fm_logits if model.params.model_type == "FM" else ffm_logits)(inside, model)


def predict(samples: DataFrame, model: Model, output_prob: bool = False) -> DataFrame:
    """seq, y, prediction: the logit, or the probability of y = 1."""
    out: Column = sigmoid(F.col("logit")) if output_prob else F.col("logit")
    return logits(samples, model).select("seq", "y", out.alias("prediction"))
