"""Micro-batch scoring: one batch at a time, safe to retry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.plans.scoring import recent_history, responses, score_and_explain, score_batch
from riskloom.plans.training import RiskModels

CADENCE = "15 minutes"


def write_once(df: DataFrame, path: str, batch_id: int) -> None:
    """A retried batch replaces its own partition and nothing else."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "batch_id"
    ).parquet(path)


def against_history(
    score: Callable[[DataFrame, DataFrame], DataFrame], path: str, store: str, history: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``score(batch, past)`` goes to ``path``, the rows of the batch to ``store``.

    ``past`` holds the batches of smaller numbers, and ``history``, rows of the same columns from before
    the stream. A batch replaces its own part of the store first and is read back from there, so its
    source is read once, and a retried batch is stored once and never sees itself.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_once(batch, store, batch_id)
        schema = T.StructType([*batch.schema.fields, T.StructField("batch_id", T.LongType())])
        stored = batch.sparkSession.read.schema(schema).parquet(store)
        past = stored.filter(F.col("batch_id") < batch_id).drop("batch_id")
        if history is not None:
            past = past.unionByName(history)
        write_once(score(stored.filter(F.col("batch_id") == batch_id).drop("batch_id"), past), path, batch_id)

    return handle


def run_batches(
    source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, cadence: str = CADENCE
) -> StreamingQuery:
    """Hand every micro-batch of ``source`` to ``handle``."""
    writer = source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=cadence)).start()


def with_models(models: RiskModels, explain: bool = False) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A score for ``against_history``: fitted models over each batch, with the past of its users as history.

    Gives the responses of a batch run; ``explain`` adds the explanation of flagged rows.
    """

    def score(batch: DataFrame, past: DataFrame) -> DataFrame:
        history = recent_history(past, batch)
        return score_and_explain(models, batch, history) if explain else responses(score_batch(models, batch, history))

    return score


def score_stream(
    source: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = False,
    cadence: str = CADENCE,
) -> StreamingQuery:
    """Score every micro-batch with ``score`` into the table at ``path``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_once(score(batch), path, batch_id)

    return run_batches(source, handle, checkpoint, available_now, cadence)
