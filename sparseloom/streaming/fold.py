"""The sequential algorithm over a stream: each shard keeps its state from micro-batch to micro-batch.

Lines are dealt to shards by a hash of their key; a shard takes those of a batch one
after another, in the order of their keys, and goes on from what it had after the batch
before. Its state is a value of Spark's state store, so a stream that is started again
goes on too. The model is the average of the shards' states, as in plans.mixing.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions.params import Params
from sparseloom.operators.model import Model
from sparseloom.operators.score import valid
from sparseloom.plans.mixing import FOLDED, Fold, averaged, fold_rows
from sparseloom.sources.sparse_text import parse_samples

OUT = "shard int, rows long, loss double"


def packed(fold: Fold) -> bytes:
    """The state of a shard."""
    out = io.BytesIO()
    feats, keys = np.array(list(fold.feats), np.int64), np.array(list(fold.keys), np.int64).reshape(len(fold.keys), 2 if fold.p.model_type == "FFM" else 1)
    np.savez(out, feats=feats, keys=keys, lin=fold.lin[:, : len(feats)], fac=fold.fac[:, : len(keys)])
    return out.getvalue()


def unpacked(p: Params, state: bytes) -> Fold:
    fold, held = Fold(p), np.load(io.BytesIO(state))
    fold.feats = {int(f): i for i, f in enumerate(held["feats"])}
    fold.keys = {tuple(map(int, k)): i for i, k in enumerate(held["keys"])}
    grown = lambda a: np.concatenate([a, np.zeros_like(a, shape=(3, 64, *a.shape[2:]))], 1)
    fold.lin, fold.fac = grown(held["lin"]), grown(held["fac"])
    return fold


def fold_stream(lines: DataFrame, p: Params, file_type: str, shards: int, checkpoint: str, out: str, mode: str = "FAILFAST") -> DataFrame:
    """Run lines with places (sources.line_stream) through the shards until there are no more: shard, rows and loss (their sum, each before its step) of every batch.

    Lines that a tolerant mode passes over are left out. A batch of a shard is held in a
    task, so the bytes of a batch and the number of shards bound it; a state has a row for
    each coordinate that the shard has met, and is written anew with each batch.
    """
    p.check_format(file_type)
    read = parse_samples(lines, file_type, mode).filter(F.col("y").isNotNull()).select("seq", "y", "x")
    dealt = valid(read, p).withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int"))

    def learn(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold = unpacked(p, state.get[0]) if state.exists else Fold(p)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        loss = sum(fold.learn(int(y), [(e["field"], e["feat"], e["value"]) for e in x]) for y, x in zip(rows["y"], rows["x"]))
        state.update((packed(fold),))
        yield pd.DataFrame({"shard": [key[0]], "rows": [len(rows)], "loss": [loss]})

    folded = dealt.groupBy("shard").applyInPandasWithState(learn, OUT, "fold binary", "append", "NoTimeout")
    query = folded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return lines.sparkSession.read.schema(OUT).parquet(out)


def folded_model(spark: SparkSession, p: Params, checkpoint: str) -> Model:
    """The average of the shards' states, a coordinate over the shards that touched it."""
    states = spark.read.format("statestore").load(checkpoint).select("key.shard", F.col("value.groupState.fold").alias("fold"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for state in b.column("fold"):
                yield from fold_rows(unpacked(p, state.as_py()), 0.0, 0)

    model, _ = averaged(states.mapInArrow(rows, FOLDED), p)
    return model
