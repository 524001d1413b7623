"""Linear models by blocks of samples: a block meets each of its features once.

Where every entry meets its weight, all entries of a feature that most samples have (a
numeric column) lie in one task, and all sums go back to their samples. Here samples are
dealt into blocks of so many entries, a block asks for the weights of its features, and
what it gives for a feature is one row: a feature has at most as many rows as there are
blocks, and a step shuffles the samples once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparseloom.operators.arrays import lengths, numbers
from sparseloom.operators.model import BIAS, Model, initial_weight
from sparseloom.operators.score import valid

#: Entries of a block, as a mean: blocks are dealt by a hash of seq.
ENTRIES = 100_000


def _blocks(samples: DataFrame, p, most: int) -> tuple[DataFrame, int]:
    """block, seq, y, feats, values, and the number of blocks. A sample without entries counts as one entry."""
    total = samples.agg(F.sum(F.greatest(F.size("x"), F.lit(1)))).first()[0] or 0
    n = max(1, -(-total // most))
    block = F.pmod(F.xxhash64("seq"), F.lit(n)).cast("int").alias("block")
    return valid(samples, p).select(block, "seq", "y", F.col("x.feat").alias("feats"), F.col("x.value").alias("values")), n


def _asked(blocks: DataFrame, n: int, linear: DataFrame, w: Column) -> DataFrame:
    """of, feat, w: the weights of the features of each block, and of the bias."""
    bias = blocks.sparkSession.range(n).select(F.col("id").cast("int").alias("of"), F.lit(BIAS).alias("feat"))
    each = blocks.select(F.col("block").alias("of"), F.explode("feats").alias("feat")).distinct().union(bias)
    return each.join(linear, "feat", "left").select("of", "feat", w.alias("w"))


def _sums(cell: np.ndarray, v: np.ndarray, cells: int) -> np.ndarray:
    return np.bincount(cell, v, cells).astype(np.float64)  # whole numbers without any values


def _block(samples: pa.Table, weights: pa.Table, gradients: bool) -> pa.Table:
    """seq, y and logit of the samples of a block; with gradients, rows of feat, g and q after them."""
    feats, values = (samples[c].combine_chunks() for c in ("feats", "values"))
    known, w = numbers(weights["feat"], np.int64), numbers(weights["w"])
    n, order = lengths(feats), np.argsort(known)
    row, value = np.repeat(np.arange(len(n)), n), numbers(values.flatten())
    at = order[np.searchsorted(known, numbers(feats.flatten(), np.int64), sorter=order)]
    bias = order[0]  # the smallest of all features
    logit = w[bias] + _sums(row, w[at] * value, len(n))
    out = pa.table({"seq": samples["seq"], "y": samples["y"], "logit": logit})
    if not gradients:
        return out
    with np.errstate(over="ignore"):
        e = 1 / (1 + np.exp(-logit)) - numbers(samples["y"])
    e[samples["y"].is_null().to_numpy()] = 0
    each = e[row] * value
    g, q = _sums(at, each, len(w)), _sums(at, each * each, len(w))
    g[bias], q[bias] = e.sum(), (e * e).sum()
    given = pa.table({"feat": known.astype(np.int32), "g": g, "q": q}).slice(0, len(w) if len(n) else 0)
    return pa.concat_tables([out, given], promote_options="default")


def _by_block(blocks: DataFrame, weights: DataFrame, gradients: bool) -> DataFrame:
    seq, y = (blocks.schema[c].dataType.simpleString() for c in ("seq", "y"))
    schema = f"seq {seq}, y {y}, logit double" + ", feat int, g double, q double" * gradients
    return blocks.groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(lambda a, b: _block(a, b, gradients), schema)


def block_logits(samples: DataFrame, model: Model, most: int = ENTRIES) -> DataFrame:
    """As score.logits of a linear model: seq, y, logit. The samples are read three times."""
    blocks, n = _blocks(samples, model.params, most)
    w = F.coalesce("w", initial_weight(model.params, F.col("feat")))
    return _by_block(blocks, _asked(blocks, n, model.linear.select("feat", "w"), w), False)


def block_gradients(samples: DataFrame, linear: DataFrame, p, most: int = ENTRIES) -> DataFrame:
    """seq, y and logit of each sample, and rows of feat, g and q (the bias among them): summed gradients and squared gradients of a block. Weights that linear (feat, w) lacks are 0."""
    blocks, n = _blocks(samples, p, most)
    return _by_block(blocks, _asked(blocks, n, linear, F.coalesce("w", F.lit(0.0))), True)
