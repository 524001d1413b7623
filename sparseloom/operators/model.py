"""Models as tables, their initial values, and how they are kept.

linear:  feat, w, n, z        (the bias is feature -1)
factors: feat, v, n, z        (FM; arrays of n_factors)
         feat, field, v, n, z (FFM; an array for each field it meets)

Only coordinates that training has touched have rows. Others have initial values that
a hash of seed and coordinate gives on demand, so a model takes space for what was
seen, not for its whole feature space.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions.expressions import hash_gaussian
from sparseloom.functions.params import Params

BIAS = -1
LINEAR = "feat int, w double, n double, z double"
FACTORS = {"FM": "feat int, v array<double>, n array<double>, z array<double>", "FFM": "feat int, field int, v array<double>, n array<double>, z array<double>"}


@dataclass
class Model:
    params: Params
    linear: DataFrame
    factors: DataFrame | None = None

    @property
    def factor_key(self) -> list[str]:
        return ["feat", "field"] if self.params.model_type == "FFM" else ["feat"]


def empty_model(spark: SparkSession, p: Params) -> Model:
    factors = spark.createDataFrame([], FACTORS[p.model_type]) if p.model_type != "LR" else None
    return Model(p, spark.createDataFrame([], LINEAR), factors)


def initial_weight(p: Params, feat: Column) -> Column:
    """Of a feature that training never saw. The bias starts at 0."""
    return F.when(feat == BIAS, 0.0).otherwise(hash_gaussian(p.init_mean, p.init_stddev, p.seed, feat))


def initial_factors(p: Params, *key: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(p.n_factors - 1)), lambda k: hash_gaussian(p.init_mean, p.init_stddev, p.seed + 1, *key, k))


def dense_linear(model: Model) -> DataFrame:
    """feat, w of the whole feature space: trained weights, and initial ones elsewhere."""
    p = model.params
    every = model.linear.sparkSession.range(-1, p.n_feats).select(F.col("id").cast("int").alias("feat"))
    return every.join(model.linear, "feat", "left").select("feat", F.coalesce("w", initial_weight(p, F.col("feat"))).alias("w"))


def zero_weights(model: Model) -> DataFrame:
    """One row: has_zero, whether a trained weight or factor is exactly 0; the bias doesn't count."""
    rows = model.linear.filter(F.col("feat") != BIAS).select((F.col("w") == 0).alias("zero"))
    if model.factors is not None:
        rows = rows.union(model.factors.select(F.exists("v", lambda v: v == 0)))
    return rows.agg(F.coalesce(F.bool_or("zero"), F.lit(False)).alias("has_zero"))


def save_model(model: Model, path: str) -> None:
    """Weights, training sums and parameters, so that training can go on. Parquet with zstd."""
    spark = model.linear.sparkSession
    parts = {"linear": model.linear} | ({"factors": model.factors} if model.factors is not None else {})
    for name, df in parts.items():
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(asdict(model.params)),)], "params string").coalesce(1).write.parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> Model:
    """The saved model; tables whose columns don't fit its kind are an error."""
    p = Params(**json.loads(spark.read.parquet(f"{path}/params").first()["params"]))

    def table(name: str, schema: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        wanted = spark.createDataFrame([], schema).dtypes
        if df.dtypes != wanted:
            raise ValueError(f"{path}/{name} has columns {df.dtypes}, not {wanted}")
        return df

    return Model(p, table("linear", LINEAR), table("factors", FACTORS[p.model_type]) if p.model_type != "LR" else None)


def export_text(model: Model, path: str) -> None:
    """A line for each trained coordinate, as 'part feat [field] values', ordered by part and feature; 17 digits, so nothing is lost."""
    number = lambda c: F.format_string("%.17g", c)
    rows = model.linear.select(F.lit(0).alias("part"), "feat", F.lit(0).alias("field"), F.concat_ws(" ", F.lit("linear"), "feat", number(F.col("w"))).alias("value"))
    if model.factors is not None:
        keys = model.factor_key
        field = F.col("field") if len(keys) == 2 else F.lit(0)
        rows = rows.union(model.factors.select(F.lit(1), "feat", field, F.concat_ws(" ", F.lit("factors"), *keys, F.transform("v", lambda v: number(v)))))
    rows.orderBy("part", "feat", "field").select("value").write.text(path)


def import_text(spark: SparkSession, path: str, p: Params) -> Model:
    """Weights of an exported model. It can score; the training sums are not in the text and start from 0."""
    t = spark.read.text(path).select(F.split("value", " ").alias("t"))
    numbers = lambda start: F.transform(F.slice("t", start, F.size("t")), lambda x: x.cast("double"))
    linear = t.filter(F.col("t")[0] == "linear").select(F.col("t")[1].cast("int").alias("feat"), F.col("t")[2].cast("double").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("z"))
    if p.model_type == "LR":
        return Model(p, linear)
    keys = ["feat", "field"] if p.model_type == "FFM" else ["feat"]
    factors = t.filter(F.col("t")[0] == "factors").select(*(F.col("t")[i + 1].cast("int").alias(k) for i, k in enumerate(keys)), numbers(len(keys) + 2).alias("v"))
    zeros = F.transform("v", lambda _: F.lit(0.0))
    return Model(p, linear, factors.withColumns({"n": zeros, "z": zeros}))
