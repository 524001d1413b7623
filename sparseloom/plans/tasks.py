"""Training tasks from files to a saved model."""

from __future__ import annotations

import json
import math
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions.metrics import mean_loss
from sparseloom.functions.params import Params
from sparseloom.operators.model import Model, empty_model, save_model
from sparseloom.operators.versions import ModelLog
from sparseloom.plans.batch import batch_step, held_logits
from sparseloom.sources.sparse_text import detect_format, read_samples
from sparseloom.storage import listed, materialize, scratch_path
from sparseloom.streaming.online import evaluate_stream, mean_of, stream_lines, train_online


@dataclass
class Epoch:
    train_loss: float
    eval_loss: float | None
    seconds: float


def evaluate(samples: DataFrame, model: Model) -> float:
    return mean_loss(held_logits(samples, model), model.params.strict_loss).first()["loss"]


def evaluate_files(spark: SparkSession, p: Params, file_type: str, model: Model, mode: str) -> float:
    """Mean loss over the files of eval_data, read as a stream."""
    return mean_of(evaluate_stream(stream_lines(spark, p.eval_data), model, file_type, scratch_path(spark, "offsets"), scratch_path(spark, "evaluated"), mode))


def _keep(spark: SparkSession, place: str, row: tuple, schema: str) -> None:
    spark.createDataFrame([tuple(row)], schema).coalesce(1).write.mode("overwrite").parquet(place)


def _kept(spark: SparkSession, place: str) -> Row | None:
    """The row that was put down in a place, None if there is none (or not all of it)."""
    return spark.read.parquet(place).first() if "_SUCCESS" in listed(spark, place) else None


def _own_work(spark: SparkSession, p: Params) -> str:
    """Where this task keeps what it has done: p.work_path, whose work must be of the same task, or scratch."""
    if not p.work_path:
        return scratch_path(spark, "task")
    same = json.dumps({k: v for k, v in asdict(p).items() if k not in ("n_epochs", "work_path", "model_path")}, sort_keys=True)
    place = f"{p.work_path}/params"
    before = _kept(spark, place)
    if not before:
        _keep(spark, place, (same,), "params string")
    elif before["params"] != same:
        raise ValueError(f"{p.work_path} holds work of another task: {before['params']}")
    return p.work_path


def run(spark: SparkSession, p: Params, mode: str | None = None) -> tuple[Model, list[Epoch]]:
    """Read, train and evaluate after each epoch, and save the model if a path is given. Losses of training are those before the step.

    Online, data are folders of text files that are read as streams. mode says what
    becomes of lines that can't be read; in both tolerant modes these train nothing.

    With work_path a task that was stopped goes on: epochs that are done there are taken
    from there, an online pass after its last whole step. More epochs than before go on
    from the last one.
    """
    mode = mode or p.mode
    file_type = detect_format(spark, p.train_data)
    p.check_format(file_type)
    work, epochs = _own_work(spark, p), []
    began = time.perf_counter()

    def kept_epoch(i: int, loss: float, evaluated) -> None:
        """Losses of an epoch, found or put down."""
        nonlocal began
        place = f"{work}/epochs/epoch-{i}"
        if not _kept(spark, place):
            _keep(spark, place, (loss, evaluated() if p.eval_data else None, time.perf_counter() - began), "train_loss double, eval_loss double, seconds double")
        epochs.append(Epoch(*_kept(spark, place)))
        began = time.perf_counter()

    if p.online:
        for i, (model, loss) in enumerate(train_online(spark, p.train_data, p, file_type, mode=mode, work=work, bytes_per_batch=p.batch_bytes or None)):
            kept_epoch(i, loss, lambda: evaluate_files(spark, p, file_type, model, mode))  # noqa: B023
    else:
        readable = lambda path: materialize(read_samples(spark, path, file_type, mode).filter(F.col("y").isNotNull()), "samples")
        samples, held = readable(p.train_data), readable(p.eval_data) if p.eval_data else None
        log = ModelLog(spark, f"{work}/model", p)
        if log.last() is None:
            log.start(empty_model(spark, p))
        for i in range(p.n_epochs):
            if log.last() <= i:  # a step over all samples touches most of a model: its changes are a new base
                new, losses = batch_step(samples, log.read(i))
                _keep(spark, f"{work}/losses/epoch-{i}", mean_loss(losses, p.strict_loss).select("loss").first(), "loss double")
                log.start(new, i + 1)
            kept_epoch(i, _kept(spark, f"{work}/losses/epoch-{i}")["loss"], lambda: evaluate(held, log.read(i + 1)))  # noqa: B023
            log.forget(i)
        model = log.read(p.n_epochs)
    if p.model_path:
        save_model(model, p.model_path)
    return model, epochs
