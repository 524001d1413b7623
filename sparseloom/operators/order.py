"""Places of rows in an order, and rows up to a place, without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparseloom.storage import materialize

#: Rows of a bucket that come to the driver as counted values; bits that one histogram tells apart.
FEW, BITS = 100_000, 16


def with_positions(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """df with the place of each row in an order, from 0 on.

    Rows are dealt out by ranges of the order and sorted there; ranges are laid end to end
    by their numbers of rows. Rows that are equal in the order follow it in no order of
    their own, and many of them are dealt over several ranges.
    """
    ties = "_tie"
    keyed = df.withColumn(ties, F.monotonically_increasing_id())
    sorted_ = keyed.repartitionByRange(*order, ties).sortWithinPartitions(*order, ties)
    # numbers of rows within a range are the lower 33 bits of these ids, the range is above them
    placed = materialize(sorted_.drop(ties).withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33)
    sums = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + within).drop("_part", "_at", "_base")


def row_partitions(df: DataFrame, parts: int, *order: str | Column) -> DataFrame:
    """part: contiguous ranges of equally many rows (the last ones may have fewer) in an order, whatever its values."""
    placed = with_positions(df, *order, name="_position")
    n = placed.agg(F.ceil(F.count(F.lit(1)) / F.lit(parts)).alias("_unit"))  # one row
    return placed.crossJoin(F.broadcast(n)).withColumn("part", F.floor(F.col("_position") / F.col("_unit")).cast("int")).drop("_position", "_unit")


def kth_smallest(df: DataFrame, column: str, k: int, bits: int) -> tuple[int, int]:
    """The k-th smallest value (k from 1) of a column of whole numbers from 0 to below 2**bits, and how many rows lie below it.

    By histograms: each tells the bucket of the next 16 bits apart, until a bucket has few
    rows. To the driver come at most 65,536 counts, or the values of the last bucket.
    """
    low, shift, below, inside = 0, bits, 0, df.select(column)
    while True:
        n = inside.count()
        shift = max(0, shift - BITS) if n > FEW else 0
        counts = inside.groupBy(F.shiftright(F.col(column) - F.lit(low), shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["b"]):
            if below + r["n"] >= k:
                break
            below += r["n"]
        low += r["b"] << shift
        if not shift:
            return low, below
        inside = inside.filter((F.col(column) >= low) & (F.col(column) < low + (1 << shift)))


def first_rows(df: DataFrame, k: int, draw: Column, *key: str) -> DataFrame:
    """df with a column first: TRUE for exactly k rows (or all, if fewer), those of the smallest draws, then keys.

    draw: 53 bits. Of rows that agree in draw and key any can be taken, and exactly as many
    as are left are.
    """
    drawn = materialize(df.withColumns({"_draw": draw, "_row": F.monotonically_increasing_id()}), "drawn")
    n = drawn.count()
    if k <= 0 or k >= n:
        return drawn.drop("_draw", "_row").withColumn("first", F.lit(k > 0))
    limit, below = kth_smallest(drawn, "_draw", k, 53)
    ties = with_positions(drawn.filter(F.col("_draw") == limit).select("_row", *key), *(key or ("_row",)), name="_place")
    taken = ties.filter(F.col("_place") < k - below).select("_row", F.lit(True).alias("_taken"))
    marked = drawn.join(taken, "_row", "left")
    return marked.withColumn("first", (F.col("_draw") < limit) | F.coalesce("_taken", F.lit(False))).drop("_draw", "_row", "_taken")
