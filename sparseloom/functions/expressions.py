"""Column functions of the models: all of them stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparseloom.functions.params import Params


def sgn(x: Column) -> Column:
    """1 above 0, else -1; 0 too gives -1."""
    return F.when(x > 0, 1).otherwise(-1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(y: Column, logit: Column, strict: bool = False) -> Column:
    """-ln of the probability given to y. Never null for given values: it is computed from the logit, not from a probability that may have rounded to 0 or 1.

    strict gives what the textbook form gives once the probability has rounded: NaN where
    y is certain, infinity where the opposite is.
    """
    stable = F.log1p(F.exp(-F.abs(logit))) + F.greatest(logit, F.lit(0.0)) - y * logit
    if not strict:
        return stable
    p = sigmoid(logit)
    return (
        F.when((p == 1) & (y == 1) | (p == 0) & (y == 0), F.lit(math.nan))
        .when((p == 1) & (y == 0) | (p == 0) & (y == 1), F.lit(math.inf))
        .otherwise(stable)
    )


def ftrl_weight(n: Column, z: Column, p: Params) -> Column:
    """The weight that a coordinate's sums n (squared gradients) and z stand for; 0 up to the L1 bound."""
    return F.when(F.abs(z) <= p.w_l1, F.lit(0.0)).otherwise(-(z - sgn(z) * p.w_l1) / (p.w_l2 + (p.w_beta + F.sqrt(n)) / p.w_alpha))


def ftrl_z(w: Column, p: Params) -> Column:
    """The z at which an untouched coordinate (n = 0) has weight w."""
    return -w * (p.w_l2 + p.w_beta / p.w_alpha) - F.signum(w) * p.w_l1


def hash_draw(seed: int, *key: Column | str) -> Column:
    """Even among the whole numbers of 53 bits, the same for a key however the data are partitioned."""
    return F.xxhash64(F.lit(seed), *key).bitwiseAND(F.lit((1 << 53) - 1))


def hash_uniform(seed: int, *key: Column | str) -> Column:
    """Even in [0, 1)."""
    return hash_draw(seed, *key) / float(1 << 53)


def hash_gaussian(mean: float, stddev: float, seed: int, *key: Column | str) -> Column:
    """Normal, by two even numbers of a key."""
    u, v = hash_uniform(2 * seed, *key), hash_uniform(2 * seed + 1, *key)
    return F.lit(mean) + stddev * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def tokens(text: Column, separators: str = " ") -> Column:
    """Parts between any of the separators, empty ones left out."""
    return F.filter(F.split(text, "[" + "".join("\\" + c for c in separators) + "]+"), lambda t: t != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def block(v: Column, index: Column, width: int) -> Column:
    """Elements index * width up to the next block, of an array that holds blocks."""
    return F.slice(v, (index * width + 1).cast("int"), width)


def vector_sum(v: Column, width: int) -> Column:
    """Sum of arrays, element by element: no row is made for an element."""
    return F.array(*(F.sum(v[k]) for k in range(width)))


def number_text(x: Column) -> Column:
    """At most four decimals, half to even, without exponent and trailing zeros but one."""
    given = F.regexp_replace(F.format_string("%.4f", F.bround(x, 4)), r"(\.\d+?)0+$", "$1")
    whole = (x >= 1) & (x < 1e9) & (x == F.floor(x))  # as the values of categories are: no format for these
    return F.when(whole, F.concat(x.cast("long").cast("string"), F.lit(".0"))).otherwise(given)
