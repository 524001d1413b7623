"""Tables to sparse samples: labels, dictionaries, normalised numbers, negatives, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparseloom.functions.expressions import hash_uniform, number_text
from sparseloom.functions.params import EncodeParams
from sparseloom.storage import materialize

def label(p: EncodeParams, column: Column) -> Column:
    """1 above the threshold, else 0; with negative sampling every given row is a positive."""
    return F.lit(1) if p.neg_sampling else F.when(column > p.threshold, 1).otherwise(0)


_WHOLE, _REAL = ("byte", "short", "integer", "long"), ("float", "double", "decimal")


def _values(df: DataFrame, i: int, column: str) -> DataFrame:
    """field, value (text), whole and real: what a column's values sort by, besides their text."""
    kind, c = df.schema[column].dataType.typeName(), F.col(column)
    none = lambda t: F.lit(None).cast(t)
    whole = c.cast("long") if kind in _WHOLE else none("long")
    real = c.cast("double") if kind in _REAL else none("double")
    return df.filter(c.isNotNull()).select(F.lit(i).alias("field"), c.cast("string").alias("value"), whole.alias("whole"), real.alias("real")).distinct()


def dictionaries(train: DataFrame, columns: list[str], first: int = 1) -> DataFrame:
    """field, value (text), feat: the sorted distinct values of each column, numbered on from the column before.

    Numbers sort as numbers, other values as text. Nulls have no number. Distinct values
    are dealt out by ranges of field and value, ranked within their range, and ranges
    are laid end to end by their sums, so no column is sorted in one task.
    """
    spark = train.sparkSession
    if not columns:
        return spark.createDataFrame([], "field int, value string, feat int")
    values = _values(train, 0, columns[0])
    for i, c in enumerate(columns[1:], 1):
        values = values.unionByName(_values(train, i, c))
    order = ["field", "whole", "real", "value"]
    dealt = materialize(values.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "values")
    sums = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("rank", rank).join(base, "part").select("field", "value", (F.col("base") + F.col("rank") + (first - 1)).cast("int").alias("feat"))


def offsets(values: DataFrame, n_fields: int, first: int = 1) -> DataFrame:
    """field, cardinality, start: the first number of each field, fields laid end to end."""
    sizes = values.groupBy("field").agg(F.count(F.lit(1)).alias("cardinality"))
    every = values.sparkSession.range(n_fields).select(F.col("id").cast("int").alias("field"))
    sizes = every.join(sizes, "field", "left").select("field", F.coalesce("cardinality", F.lit(0)).alias("cardinality"))
    before = Window.orderBy("field").rowsBetween(Window.unboundedPreceding, -1)  # a row for each field
    return sizes.select("field", "cardinality", (F.coalesce(F.sum("cardinality").over(before), F.lit(0)) + first).alias("start"))


def bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: smallest and largest value of each column."""
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max)))) if columns else df.limit(0).agg(F.count(F.lit(1)).alias("none"))


def min_max(df: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Columns mapped so that the fitted bounds are 0 and 1; a constant column becomes 0 there. Other rows may lie outside."""
    wide = df.crossJoin(F.broadcast(fitted))  # one row
    scaled = {c: (F.col(c) - F.col(f"min_{c}")) / F.when(F.col(f"max_{c}") == F.col(f"min_{c}"), 1.0).otherwise(F.col(f"max_{c}") - F.col(f"min_{c}")) for c in columns}
    return wide.withColumns(scaled).select(*df.columns)


def encode(df: DataFrame, words: DataFrame, first_number: int, cat: list[str], num: list[str], y: Column, seq: str) -> DataFrame:
    """Samples (seq, y, x) of a table. A value that the dictionary lacks, or a null, gets feature 0; numbers have one feature each, from first_number on, and a null counts as 0.

    The dictionary is joined, field by field; Spark broadcasts it where its statistics
    say that it is small.
    """
    rows = df.select(F.col(seq).alias("seq"), y.cast("int").alias("y"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cat)), *(F.coalesce(F.col(c), F.lit(0)).cast("float").alias(f"n{i}") for i, c in enumerate(num)))
    for i in range(len(cat)):
        one = words.filter(F.col("field") == i).select(F.col("value").alias(f"c{i}"), F.col("feat").alias(f"f{i}"))
        rows = rows.join(one, f"c{i}", "left")
    entry = lambda field, feat, value: F.struct(F.lit(field).alias("field"), feat.cast("int").alias("feat"), value.cast("float").alias("value"))
    x = [entry(i, F.coalesce(f"f{i}", F.lit(0)), F.lit(1.0)) for i in range(len(cat))]
    x += [entry(len(cat) + i, F.lit(first_number + i), F.col(f"n{i}")) for i in range(len(num))]
    return rows.select("seq", "y", F.array(*x).alias("x"))


def with_negatives(samples: DataFrame, sizes: list[tuple[int, int]], ranges: list[tuple[float, float, bool]], n: int, seed: int) -> DataFrame:
    """Samples and n negatives (y = 0) for each: every entry is drawn anew and apart from the others.

    sizes: first number and cardinality of each categorical field; ranges: smallest and
    largest value of each numeric field, and whether it is of whole numbers (both ends
    can be drawn). Draws are hashes of seq, copy and field.
    """
    if n <= 0:
        return samples
    copies = samples.select("seq", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("copy"), "x")
    drawn = []
    for i, (start, size) in enumerate(sizes):
        u = hash_uniform(seed, "seq", "copy", F.lit(i))
        drawn.append(F.struct(F.lit(i).alias("field"), (start + F.floor(u * size)).cast("int").alias("feat"), F.lit(1.0).cast("float").alias("value")))
    for i, (low, high, whole) in enumerate(ranges, len(sizes)):
        u = hash_uniform(seed, "seq", "copy", F.lit(i))
        value = low + F.floor(u * (high - low + 1)) if whole else low + u * (high - low)
        drawn.append(F.struct(F.lit(i).alias("field"), F.col("x")[i].feat.alias("feat"), value.cast("float").alias("value")))
    negatives = copies.select(F.xxhash64("seq", "copy").alias("seq"), F.lit(0).alias("y"), F.array(*drawn).alias("x"))
    return samples.unionByName(negatives)


def lines(samples: DataFrame, file_type: str) -> DataFrame:
    """seq and value: a line of text for each sample. Values of 0 are written."""
    one = (lambda e: F.concat_ws(":", e.field, e.feat, number_text(e.value))) if file_type == "libffm" else (lambda e: F.concat_ws(":", e.feat, number_text(e.value)))
    return samples.select("seq", F.concat_ws(" ", F.col("y").cast("string"), F.transform("x", one)).alias("value"))


def shuffled_by(seed: int, *key: str) -> tuple[Column | str, ...]:
    """What shuffled rows are sorted by: an order that seed and key fix, whatever the partitioning."""
    return F.xxhash64(F.lit(seed), *key), *key


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    return df.orderBy(*shuffled_by(seed, *key))


def transform(train: DataFrame, evaluation: DataFrame, p: EncodeParams, seq: str) -> tuple[DataFrame, DataFrame]:
    """Both tables as samples; dictionaries and bounds come from train."""
    names = [c for c in train.columns if c != seq]
    cat, num = [names[i] for i in p.cat_cols], [names[i] for i in p.num_cols]
    if p.normalize:
        fitted = bounds(train, num)
        train, evaluation = min_max(train, fitted, num), min_max(evaluation, fitted, num)
    words = dictionaries(train, cat)
    laid = {r["field"]: (int(r["start"]), int(r["cardinality"])) for r in offsets(words, len(cat)).collect()}  # a row for each field
    sizes = [laid[i] for i in range(len(cat))]
    first = sizes[-1][0] + sizes[-1][1] if sizes else 1
    out = []
    for df in (train, evaluation):
        samples = encode(df, words, first, cat, num, label(p, F.col(names[p.label_col])), seq)
        if p.neg_sampling and p.num_neg > 0:
            low = bounds(df, num).first()
            whole = [df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in num]
            samples = with_negatives(samples, sizes, [(float(low[f"min_{c}"]), float(low[f"max_{c}"]), w) for c, w in zip(num, whole)], p.num_neg, p.seed)
        out.append(samples)
    return out[0], out[1]
