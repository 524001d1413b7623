"""Batch training on entries that are written once, in buckets of features.

A step joins all entries with the model. Here entries lie on disk in buckets by feature,
sorted, and each version of the model is written in the same buckets, so the join has no
exchange on either side; what entries give is shuffled once a step, back to their
samples: sums for a linear model, whose samples hold their entries anyway. A
feature of many samples is split into parts by a hash of the sample, and its row of the
model is there for each part, so no bucket outgrows a task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparseloom.functions.params import Params
from sparseloom.operators.model import Model, empty_model
from sparseloom.operators.score import entries, valid
from sparseloom.plans.batch import current, scored_met, step_of, weights_by_feature
from sparseloom.plans.batch import kept as kept_model
from sparseloom.storage import materialize, scratch_path

#: Entries of one feature in one part.
PART = 1_000_000
KEY = ("feat", "part")


def _bucketed(df: DataFrame, buckets: int, purpose: str) -> str:
    """The table that df is written to, a file for each bucket."""
    name = f"{purpose}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *KEY)
    dealt.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", scratch_path(df.sparkSession, purpose)).saveAsTable(name)
    return name


@dataclass
class Entries:
    """Samples, their entries in buckets, and the number of parts of the features that have several."""

    samples: DataFrame
    table: str
    parts: DataFrame
    buckets: int
    params: Params

    @classmethod
    def write(cls, samples: DataFrame, p: Params, buckets: int | None = None, most: int = PART) -> Entries:
        """Entries of samples, invalid ones left out. most: how many entries of a feature share a part."""
        spark = samples.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        inside = valid(samples, p)
        each = entries(inside, p.model_type == "FFM")
        sizes = each.filter(F.col("feat").isNotNull()).groupBy("feat").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("parts"))
        parts = materialize(sizes.filter("parts > 1"), "parts")  # at most a row for each `most` entries
        of = F.pmod(F.xxhash64("seq"), F.when(F.col("feat").isNull(), F.lit(1 << 30)).otherwise(F.coalesce("parts", F.lit(1))))
        dealt = each.join(parts, "feat", "left").withColumn("part", of.cast("int")).drop("parts")
        return cls(inside, _bucketed(dealt, buckets, "entries"), parts, buckets, p)

    def met(self, weights: DataFrame) -> DataFrame:
        """Entries with what they meet of a model: a join of buckets."""
        spark = weights.sparkSession
        every: Column = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        spread = weights.join(self.parts, "feat", "left").select(*weights.columns, every)
        model = _bucketed(spread, self.buckets, "model")
        return spark.table(self.table).join(spark.table(model), list(KEY), "left")


def bucketed_step(given: Entries, model: Model) -> tuple[Model, DataFrame]:
    """As plans.batch.batch_step, over entries in buckets."""
    p = model.params
    linear, factors = current(model)
    scored = scored_met(given.samples, given.met(weights_by_feature(linear, factors, p)), linear, p)
    step = step_of(scored, model, "full")
    return Model(p, step.linear, step.factors), step.losses


def train_bucketed(samples: DataFrame, p: Params, start: Model | None = None, buckets: int | None = None, most: int = PART) -> Model:
    """n_epochs steps over all samples, whose entries are written in buckets once."""
    given = Entries.write(samples, p, buckets, most)
    model = start or empty_model(samples.sparkSession, p)
    for _ in range(p.n_epochs):
        model = kept_model(bucketed_step(given, model)[0])
    return model
