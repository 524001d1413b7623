"""Sequential FTRL within shards, parameters averaged over shards.

A shard's samples are taken one after another, in single precision; each sees what the one before left. With one shard this is the plain
sequential algorithm. With more, every round starts all shards from the average of
the round before. A shard is one task: Spark sorts its samples, and they pass through it
one after another, so it holds the rows of its state and no samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparseloom.functions.expressions import vector_sum
from sparseloom.functions.params import Params
from sparseloom.operators.model import BIAS, Model, empty_model
from sparseloom.operators.score import valid
from sparseloom.plans.batch import kept
from sparseloom.storage import materialize

#: A shard's state as rows, and its loss and samples beside the bias.
FOLDED = "feat int, field int, w float, n float, z float, v array<float>, vn array<float>, vz array<float>, loss double, rows long"


class Fold:
    """The state of one shard: rows of w, n and z for the coordinates it has met. A sample gathers its rows, and puts them back."""

    def __init__(self, p: Params):
        self.p, k = p, p.n_factors
        self.feats: dict[int, int] = {BIAS: 0}
        self.keys: dict[tuple[int, ...], int] = {}
        self.lin, self.fac = np.zeros((3, 64), np.float32), np.zeros((3, 64, k), np.float32)
        self.alpha, self.l1, self.l2, self.beta = (np.float32(x) for x in (p.w_alpha, p.w_l1, p.w_l2, p.w_beta))

    @property
    def linear(self) -> dict[int, np.ndarray]:
        """feat -> w, n, z"""
        return {f: self.lin[:, i] for f, i in self.feats.items()}

    @property
    def factors(self) -> dict[tuple[int, ...], np.ndarray]:
        """feat[, field] -> arrays of w, n, z"""
        return {key: self.fac[:, i] for key, i in self.keys.items()}

    def row(self, feat: int, state: tuple[float, float, float] | None = None) -> int:
        i = self.feats.setdefault(feat, len(self.feats))
        if i >= self.lin.shape[1]:
            self.lin = np.concatenate([self.lin, np.zeros_like(self.lin)], 1)
        if state:
            self.lin[:, i] = state
        return i

    def factor_row(self, key: tuple[int, ...], state: list | None = None) -> int:
        i = self.keys.get(key)
        if i is None:
            p = self.p
            i = self.keys[key] = len(self.keys)
            if i >= self.fac.shape[1]:
                self.fac = np.concatenate([self.fac, np.zeros_like(self.fac)], 1)
            if state is None and p.factor_init == "warm":
                w = np.random.default_rng([p.seed, *(k + 1 for k in key)]).normal(p.init_mean, p.init_stddev, p.n_factors)
                self.fac[2, i] = -w * (p.w_l2 + p.w_beta / p.w_alpha) - np.sign(w) * p.w_l1
        if state is not None:
            self.fac[:, i] = state
        return i

    def prepare(self, x: list[tuple[int, int, float]]) -> tuple[np.ndarray, ...]:
        """Rows and values of a sample (the bias first), rows of its factors, and the products of pairs."""
        kind = self.p.model_type
        rows = np.array([0, *(self.row(feat) for _, feat, _ in x)])
        values = np.array([1, *(v for _, _, v in x)], np.float32)
        own, product = np.zeros(0, np.int64), values[1:]
        if kind == "FM":
            own = np.array([self.factor_row((feat,)) for _, feat, _ in x], np.int64)
        elif kind == "FFM":
            both = [(x[a], x[b]) for a in range(len(x)) for b in range(a + 1, len(x))]
            own = np.array([self.factor_row((i, g)) for (_, i, _), (g, _, _) in both] + [self.factor_row((j, f)) for (f, _, _), (_, j, _) in both], np.int64)
            product = np.array([np.float32(v) * np.float32(u) for (_, _, v), (_, _, u) in both], np.float32)
        return rows, values, own, product

    def weight(self, n: np.ndarray, z: np.ndarray) -> np.ndarray:
        w = (np.where(z > 0, self.l1, -self.l1) - z) / (self.l2 + (self.beta + np.sqrt(n)) / self.alpha)
        w[np.abs(z) <= self.l1] = 0
        return w

    def move(self, state: np.ndarray, rows: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """Rows change by their gradients; weights stay what this sample used. Steps of one row add up: their roots cancel."""
        q = g * g
        if len(set(rows.tolist())) < len(rows):
            rows, first, back = np.unique(rows, return_index=True, return_inverse=True)
            sums = np.zeros((2, *w[first].shape), np.float32)
            np.add.at(sums[0], back, g)
            np.add.at(sums[1], back, q)
            w, g, q = w[first], sums[0], sums[1]
        n = state[1, rows]
        new = n + q
        state[2, rows] += g - (np.sqrt(new) - np.sqrt(n)) / self.alpha * w
        state[1, rows] = new

    def step(self, y: int, sample: tuple[np.ndarray, ...]) -> float:
        """One sample; its loss before the step."""
        rows, values, own, product = sample
        w = self.lin[0, rows] = self.weight(self.lin[1, rows], self.lin[2, rows])
        logit = (w * values).sum()
        if len(own):
            v = self.fac[0, own] = self.weight(self.fac[1, own], self.fac[2, own])
            if self.p.model_type == "FM":
                vx = v * product[:, None]
                total = vx.sum(0)
                logit += np.float32(0.5) * (total * total - (vx * vx).sum(0)).sum()
            else:
                half = len(product)
                logit += ((v[:half] * v[half:]).sum(1) * product).sum()
        t = float(logit)
        e = np.float32(1 / (1 + np.exp(-np.float64(logit)))) - np.float32(y)
        self.move(self.lin, rows, w, e * values)
        if len(own):
            if self.p.model_type == "FM":
                g = e * (product[:, None] * total - v * (product * product)[:, None])
            else:
                g = e * np.concatenate([v[half:], v[:half]]) * np.concatenate([product, product])[:, None]
            self.move(self.fac, own, v, g)
        return float(np.log1p(np.exp(-abs(t))) + max(t, 0.0) - y * t)

    def learn(self, y: int, x: list[tuple[int, int, float]]) -> float:
        return self.step(y, self.prepare(x))


#: Rows of a shard's state that leave it at a time.
PIECE = 10_000


def fold_rows(fold: Fold, loss: float, n: int) -> Iterator[pa.RecordBatch]:
    """The state of a shard as rows of FOLDED, piece by piece."""
    k = fold.p.n_factors
    fields = pa.schema([("feat", pa.int32()), ("field", pa.int32()), *((c, pa.float32()) for c in ("w", "n", "z")), *((c, pa.list_(pa.float32())) for c in ("v", "vn", "vz")), ("loss", pa.float64()), ("rows", pa.int64())])

    def batch(feat: np.ndarray, field: np.ndarray, numbers: list, arrays: list, sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(feat, pa.int32()), pa.array(field, pa.int32()), *numbers, *arrays, *(pa.array(s) for s in sums)], schema=fields)

    for part in batched(fold.feats.items(), PIECE):
        feat, rows = np.array(part, np.int64).T
        bias, none = feat == BIAS, pa.nulls(len(feat), pa.list_(pa.float32()))
        yield batch(feat, np.full(len(feat), -1), [pa.array(s) for s in fold.lin[:, rows]], [none] * 3, (np.where(bias, loss, 0.0), np.where(bias, n, 0)))
    for part in batched(fold.keys.items(), PIECE):
        feat, field = np.array([(*key, -1)[:2] for key, _ in part], np.int64).T
        rows, m = [i for _, i in part], len(part)
        cuts = pa.array(np.arange(0, k * m + 1, k), pa.int32())
        arrays = [pa.ListArray.from_arrays(cuts, pa.array(s.ravel())) for s in fold.fac[:, rows]]
        yield batch(feat, field, [pa.nulls(m, pa.float32())] * 3, arrays, (np.zeros(m), np.zeros(m, np.int64)))


def _fold(p: Params, epochs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards one after another, each as the rows of its state and its samples in the order they are taken in. A task holds the state of one shard and no samples but those of a batch."""
    shard, fold, loss, n = None, Fold(p), 0.0, 0
    for b in batches:
        shards, passes, ys = (b.column(c).to_pylist() for c in ("shard", "epoch", "y"))
        x, state = b.column("x"), b.column("state")
        ends, entry = x.offsets.to_numpy(), [x.values.field(c).to_numpy(zero_copy_only=False) for c in ("field", "feat", "value")]
        for i, (of, epoch, y) in enumerate(zip(shards, passes, ys)):
            if of != shard:
                if shard is not None:
                    yield from fold_rows(fold, loss, n)
                shard, fold, loss, n = of, Fold(p), 0.0, 0
            if epoch < 0:
                s = state[i].as_py()
                if s["w"] is not None:
                    fold.row(s["feat"], (s["w"], s["n"], s["z"]))
                if s["v"] is not None:
                    fold.factor_row((s["feat"], s["field"]) if p.model_type == "FFM" else (s["feat"],), [s["v"], s["vn"], s["vz"]])
                continue
            before = fold.learn(y, list(zip(*(c[ends[i] : ends[i + 1]].tolist() for c in entry))))
            if epoch == epochs - 1:
                loss, n = loss + before, n + 1
    if shard is not None:
        yield from fold_rows(fold, loss, n)


def _state(model: Model, wanted: DataFrame) -> DataFrame:
    """The part of the model that each shard needs. wanted: for_shard, feat."""
    none = {c: F.lit(None).cast(t) for c, t in (("w", "double"), ("n", "double"), ("z", "double"), ("v", "array<double>"), ("vn", "array<double>"), ("vz", "array<double>"))}
    state = model.linear.select("feat", F.lit(-1).alias("field"), "w", "n", "z", none["v"].alias("v"), none["vn"].alias("vn"), none["vz"].alias("vz"))
    if model.factors is not None:
        field = F.col("field") if "field" in model.factors.columns else F.lit(-1)
        state = state.union(model.factors.select("feat", field, none["w"], none["n"], none["z"], "v", F.col("n"), F.col("z")))
    return wanted.join(state, "feat").select("for_shard", *state.columns)


def mixing_round(samples: DataFrame, model: Model, shards: int, epochs: int = 1, shuffle: int | None = None) -> tuple[Model, DataFrame]:
    """Samples are taken in the order of seq, or, given the number of an epoch, in an order that it and the seed fix.

    Returns the average of the shards' models, a coordinate over the shards that touched it; and one row: loss (mean over the samples, in the last epoch) and n."""
    p = model.params
    dealt = valid(samples, p).select(F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard"), "seq", "y", "x")
    wanted = dealt.select(F.col("shard").alias("for_shard"), F.explode(F.concat(F.transform("x", lambda e: e.feat), F.array(F.lit(BIAS)))).alias("feat")).distinct()
    taken = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))) if epochs > 1 else F.lit(0))
    draw = F.lit(0).cast("long") if shuffle is None else F.xxhash64(F.lit(p.seed), F.col("epoch") + shuffle, F.col("seq"))
    state = _state(model, wanted)
    held = state.select(F.col("for_shard").alias("shard"), F.lit(-1).alias("epoch"), F.struct(*(c for c in state.columns if c != "for_shard")).alias("state"))
    rows = held.unionByName(taken.withColumn("draw", draw), allowMissingColumns=True)
    order = ["shard", "epoch", "draw", F.asc_nulls_last("seq"), "y", "x"]  # what was in the model comes first
    laid = rows.repartitionById(shards, "shard").sortWithinPartitions(*order).select("shard", "epoch", "y", "x", "state")
    folded = laid.mapInArrow(lambda batches: _fold(p, epochs, batches), FOLDED)
    return averaged(materialize(folded, "folded"), p)  # linear weights and factors come from one run of the shards


def averaged(folded: DataFrame, p: Params) -> tuple[Model, DataFrame]:
    """Rows of shards (FOLDED) as their average, a coordinate over the shards that touched it; and one row: loss (mean over the samples) and n."""
    k = p.n_factors
    linear = folded.filter(F.col("w").isNotNull()).groupBy("feat").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in ("w", "n", "z")), F.sum("loss").alias("loss"), F.sum("rows").alias("rows"))
    factors = None
    if p.model_type != "LR":
        count = F.count(F.lit(1))
        sums = folded.filter(F.col("v").isNotNull()).groupBy("feat", "field").agg(count.alias("m"), *(vector_sum(F.col(c).cast("array<double>"), k).alias(c) for c in ("v", "vn", "vz")))
        mean = lambda c: F.transform(c, lambda s: s / F.col("m"))
        factors = sums.select("feat", *["field"] * (p.model_type == "FFM"), mean("v").alias("v"), mean("vn").alias("n"), mean("vz").alias("z"))
    losses = linear.filter(F.col("feat") == BIAS).select((F.col("loss") / F.col("rows")).alias("loss"), F.col("rows").alias("n"))
    return Model(p, linear.select("feat", "w", "n", "z"), factors), losses


def train_mixing(samples: DataFrame, p: Params, shards: int, start: Model | None = None) -> Model:
    """n_epochs rounds; every epoch takes the samples in another order."""
    model = start or empty_model(samples.sparkSession, p)
    for epoch in range(p.n_epochs):
        model = kept(mixing_round(samples, model, shards, shuffle=epoch)[0])
    return model
