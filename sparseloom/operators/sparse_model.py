"""Linear weights without their zeros: two filters beside the weights that are left.

Training with an L1 bound leaves most touched weights at exactly 0, and a coordinate
without a row has its initial value, so zeros can't simply go. Here one filter holds
the touched coordinates and another those that have a weight left. An entry outside the
first has its initial value, one outside the second counts nothing, and only what is
left meets the weights in a join. Untouched coordinates that pass the first filter by
chance are found when it is made and keep a row, so scores are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparseloom.functions.params import Params
from sparseloom.operators.model import BIAS, Model, initial_weight
from sparseloom.operators.score import entries, valid, with_bias
from sparseloom.storage import materialize

#: Places of a coordinate in a filter, and the bits for each coordinate.
PLACES, BITS_EACH = 4, 16
#: A filter has 2**10 to 2**23 bits (1 MB), however large the model is; beyond that more passes by chance, and has a row.
LEAST_BITS, MOST_BITS = 10, 23


@dataclass
class SparseLinear:
    """weights: feat, w (trained weights other than 0, initial ones of what passes the filter by chance, the bias). filters: one row of touched and kept, arrays of 64-bit words."""

    params: Params
    weights: DataFrame
    filters: DataFrame


def _places(feat: Column, words: Column | int) -> list[tuple[Column, Column]]:
    """Word and bit of each place of a coordinate, in a filter of so many words."""
    hashes = [F.xxhash64(F.lit(i), feat.cast("int")) for i in range(PLACES)]
    return [(F.pmod(F.shiftright(h, 6), F.lit(words) if isinstance(words, int) else words.cast("long")).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")) for h in hashes]


def passes(feat: Column, words: Column) -> Column:
    """Whether a coordinate may be in the filter; never false for one that is."""
    return reduce(Column.__and__, (F.getbit(F.get(words, word), bit) == 1 for word, bit in _places(feat, F.size(words))))


def coordinate_filter(feats: DataFrame, name: str) -> DataFrame:
    """One row with the filter of a column feat. Its words, 2**17 at most, are summed by place first."""
    n = feats.count()
    words = 1 << (min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n).bit_length())) - 6)
    at = feats.select(F.explode(F.array(*(F.struct(w.alias("word"), b.alias("bit")) for w, b in _places(F.col("feat"), words)))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.bit"))
    held = at.groupBy(F.col("p.word").alias("word")).agg(F.bit_or(one).alias("bits"))
    every = feats.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(held, "word", "left")
    filled = F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(filled)), lambda x: x.bits).alias(name))


def sparse_linear(model: Model) -> SparseLinear:
    """The linear part of a model without its zeros. The whole feature space is gone through once, here, for what passes by chance."""
    p = model.params
    linear = model.linear.filter(F.col("feat") != BIAS)
    touched = materialize(coordinate_filter(linear, "touched"), "touched")
    left = linear.filter("w != 0").select("feat", "w")
    space = linear.sparkSession.range(p.n_feats).select(F.col("id").cast("int").alias("feat"))
    by_chance = space.crossJoin(F.broadcast(touched)).filter(passes(F.col("feat"), F.col("touched"))).select("feat").join(linear, "feat", "left_anti")
    by_chance = by_chance.select("feat", initial_weight(p, F.col("feat")).alias("w")).filter("w != 0")
    rows = materialize(left.union(by_chance), "weights")
    filters = materialize(touched.crossJoin(coordinate_filter(rows, "kept")), "filters")
    bias = model.linear.filter(F.col("feat") == BIAS).select("feat", "w")
    return SparseLinear(p, rows.union(bias), filters)


def _with_filters(samples: DataFrame, sparse: SparseLinear) -> DataFrame:
    """Entries beside the filters. These have one row of at most 2 MB and stay within a stage: what comes after has to leave them behind in plain column expressions, or they would be copied for each entry."""
    return entries(samples).crossJoin(F.broadcast(sparse.filters))


def meeting_entries(samples: DataFrame, sparse: SparseLinear) -> DataFrame:
    """seq, y, feat, value of the entries that have to meet the weights."""
    given = _with_filters(samples, sparse).filter(F.col("feat").isNotNull() & passes(F.col("feat"), F.col("touched")) & passes(F.col("feat"), F.col("kept")))
    return given.select("seq", "y", "feat", "value")


def sparse_logits(samples: DataFrame, sparse: SparseLinear) -> DataFrame:
    """seq, y, logit, as logits() of the linear model gives them: a row for each sample, those without entries too.

    The samples are read twice: once for sums over untouched entries, which are made
    where the samples are read, and once for the entries that go into the join.
    """
    inside = valid(samples, sparse.params)
    initial = F.when(~passes(F.col("feat"), F.col("touched")), initial_weight(sparse.params, F.col("feat")) * F.col("value"))
    untouched = _with_filters(inside, sparse).select("seq", "y", initial.alias("wx"))
    met = meeting_entries(inside, sparse).join(sparse.weights.filter(F.col("feat") != BIAS), "feat").select("seq", "y", (F.col("w") * F.col("value")).alias("wx"))
    sums = untouched.union(met).groupBy("seq").agg(F.max("y").alias("y"), F.coalesce(F.sum("wx"), F.lit(0.0)).alias("s"))
    return with_bias(sums, sparse.weights, F.col("w")).select("seq", "y", (F.col("bias") + F.col("s")).alias("logit"))
