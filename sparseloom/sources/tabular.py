"""Tables that are encoded into samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions.expressions import hash_draw
from sparseloom.functions.params import EncodeParams
from sparseloom.operators.order import first_rows


def read_csv(spark: SparkSession, path: str, p: EncodeParams) -> DataFrame:
    return spark.read.csv(path, header=p.header, inferSchema=True, sep=p.sep)


def read_train_eval(spark: SparkSession, p: EncodeParams, data_path: str = "", train_path: str = "", eval_path: str = "") -> tuple[DataFrame, DataFrame]:
    """A file split at random, or two files; data_path comes first."""
    if data_path:
        return split(read_csv(spark, data_path, p), p.train_share, p.seed)
    if train_path and eval_path:
        return read_csv(spark, train_path, p), read_csv(spark, eval_path, p)
    raise ValueError("give data_path, or train_path and eval_path")


def split(df: DataFrame, train_share: float, seed: int, *key: str) -> tuple[DataFrame, DataFrame]:
    """Train and eval rows by a hash of the key (all columns if none): the same rows in every run and partitioning.

    Exactly round(train_share * rows) rows are for training, those of the smallest draws.
    """
    key = key or tuple(df.columns)
    marked = first_rows(df, round(train_share * df.count()), hash_draw(seed, *key), *key)
    return marked.filter("first").drop("first"), marked.filter("NOT first").drop("first")
