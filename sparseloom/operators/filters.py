"""Entries and rows that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonzero(x: Column) -> Column:
    return F.filter(x, lambda e: e.value != 0)


def in_range(x: Column, n_feats: int, n_fields: int | None = None) -> Column:
    """Entries of features 0 to n_feats - 1, and of fields likewise where fields count. Their order stays."""
    ok = lambda e: (e.feat >= 0) & (e.feat < n_feats)
    if n_fields is None:
        return F.filter(x, ok)
    return F.filter(x, lambda e: ok(e) & (e.field >= 0) & (e.field < n_fields))


def has_zero(weights: DataFrame, column: str) -> DataFrame:
    """One row: has_zero, whether a weight (or an element of an array of weights) is exactly 0; false without rows."""
    c = F.exists(column, lambda w: w == 0) if weights.schema[column].dataType.typeName() == "array" else F.col(column) == 0
    return weights.agg(F.coalesce(F.bool_or(c), F.lit(False)).alias("has_zero"))
