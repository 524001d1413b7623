"""Online training: lines arrive as files, each micro-batch is a step, the model is a base and a log of changes.

Batch b makes version b + 1 of the model from version b, so a batch that is run again
after a failure writes the same changes in the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.functions.metrics import mean_loss
from sparseloom.functions.params import Params
from sparseloom.operators.model import Model, empty_model
from sparseloom.operators.versions import ModelLog
from sparseloom.plans.batch import batch_changes, held_logits
from sparseloom.sources.line_stream import bounded_lines
from sparseloom.sources.sparse_text import parse_samples
from sparseloom.storage import listed, remove, scratch_path

LOSSES = "batch_id long, loss double, n long"


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Lines of the text files of a folder as a stream; how many files make a batch bounds what a step reads."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def _readable(batch: DataFrame, path: str, file_type: str, mode: str) -> DataFrame:
    """The samples of a batch, kept in path: lines are parsed and keys drawn once. Lines that a tolerant mode passes over are left out."""
    keyed = batch if "seq" in batch.columns else batch.select(F.monotonically_increasing_id().alias("seq"), "value")
    samples = parse_samples(keyed, file_type, mode).filter(F.col("y").isNotNull()).select("seq", "y", "x")
    samples.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(samples.schema).parquet(path)


def train_stream(lines: DataFrame, p: Params, file_type: str, checkpoint: str, models: str, start: Model | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Run the stream over all that is there: losses of its batches, as batch_id, loss (mean, before the step) and n. The model is a ModelLog in models.

    A step reads what its lines touch of the model, and writes what it changes. With a
    checkpoint and models of before it goes on from them, and start is not used. Lines are
    parsed and given a key once for each batch, in a table that goes after the step.
    """
    p.check_format(file_type)
    spark = lines.sparkSession
    if ModelLog(spark, models, p).last() is None:
        ModelLog(spark, models, p).start(start or empty_model(spark, p))

    def step(batch: DataFrame, batch_id: int) -> None:
        log, given = ModelLog(batch.sparkSession, models, p), f"{models}/input-{batch_id}"
        done = batch_changes(_readable(batch, given, file_type, mode), log.read(batch_id))
        mean_loss(done.losses, p.strict_loss).select(F.lit(batch_id).cast("long").alias("batch_id"), "loss", "n").write.mode("overwrite").parquet(f"{models}/losses/batch={batch_id}")
        log.append(batch_id + 1, done.linear, done.factors)
        log.compact()
        remove(batch.sparkSession, given)

    run_through(lines, step, checkpoint)
    return batch_losses(spark, f"{models}/losses")


def run_through(lines: DataFrame, step, checkpoint: str) -> None:
    """Run a stream until all that is there has been through step.

    Lines with places of their own (sources.line_stream) come batch by batch until there
    are no more; Spark knows what is there of other sources.
    """
    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if "seq" not in lines.columns:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def batch_losses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOSSES).parquet(f"{path}/*") if listed(spark, path) else spark.createDataFrame([], LOSSES)


def latest_model(spark: SparkSession, models: str, p: Params) -> Model:
    return ModelLog(spark, models, p).read()


def mean_of(losses: DataFrame) -> float:
    """Mean over all samples of the losses of batches; NaN without any."""
    total = losses.agg(F.sum(F.col("loss") * F.col("n")) / F.sum("n")).first()[0]
    return float("nan") if total is None else total


def train_online(
    spark: SparkSession, path: str, p: Params, file_type: str, files_per_batch: int = 1, mode: str = "FAILFAST", work: str | None = None, bytes_per_batch: int | None = None
) -> Iterator[tuple[Model, float]]:
    """n_epochs passes over the files of a folder: the model after each pass and the mean progressive loss in it.

    A step takes files_per_batch files, or bytes_per_batch bytes, within files too. work
    keeps the passes: what is done there is not done again, and a pass that was stopped
    goes on after its last whole step.
    """
    model, work = None, work or scratch_path(spark, "online")
    for k in range(p.n_epochs):
        here = f"{work}/pass-{k}"
        if "_SUCCESS" not in listed(spark, f"{here}/done"):
            lines = bounded_lines(spark, path, f"{here}/files", bytes_per_batch) if bytes_per_batch else stream_lines(spark, path, files_per_batch)
            losses = train_stream(lines, p, file_type, f"{here}/offsets", f"{here}/model", model, mode)
            spark.createDataFrame([(mean_of(losses),)], "loss double").write.mode("overwrite").parquet(f"{here}/done")
        model = latest_model(spark, f"{here}/model", p)
        yield model, spark.read.parquet(f"{here}/done").first()["loss"]


def evaluate_stream(lines: DataFrame, model: Model, file_type: str, checkpoint: str, out: str, mode: str = "FAILFAST") -> DataFrame:
    """Losses of a stream under a fixed model, batch by batch: batch_id, loss, n."""

    def step(batch: DataFrame, batch_id: int) -> None:
        given = f"{out}/input-{batch_id}"
        samples = _readable(batch, given, file_type, mode)
        mean_loss(held_logits(samples, model), model.params.strict_loss).select(F.lit(batch_id).cast("long").alias("batch_id"), "loss", "n").write.mode("overwrite").parquet(f"{out}/losses/batch={batch_id}")
        remove(batch.sparkSession, given)

    run_through(lines, step, checkpoint)
    return batch_losses(lines.sparkSession, f"{out}/losses")
