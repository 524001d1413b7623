"""Connected components by alternating star steps, for edge tables that no driver could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparseloom.llm.common import materialize, own_exchange


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one (or to itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(own_exchange(least, "a"), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(own_exchange(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node), for nodes that have an edge to another one. Edges: columns a and b, whole numbers.

    Neither a node's neighbours nor a component are ever gathered in one place: minima
    are summed up before they are shuffled and joined back. Each round is written to
    the shared folder, so a lost executor costs one round at most. The number of
    rounds grows with the logarithm of a component's width.
    """
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        now = materialize(_small_star(_large_star(now)), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = new
    raise RuntimeError(f"components are not settled after {rounds} rounds")
