"""Losses over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparseloom.functions.expressions import log_loss


def row_losses(scored: DataFrame, strict: bool = False) -> DataFrame:
    return scored.withColumn("loss", log_loss(F.col("y"), F.col("logit"), strict))


def mean_loss(scored: DataFrame, strict: bool = False) -> DataFrame:
    """One row: loss and n. NaN without rows; NaN or infinite losses carry through, and none is left out."""
    sums = row_losses(scored, strict).agg(F.sum("loss").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("s") / F.col("n")).alias("loss"), "n")
