"""Arriving rows measured against stored history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import wall_micros
from riskloom.operators.trailing import empty_measures, trailing, velocity_measures
from riskloom.plans.scoring import recent_history


def velocity_with_history(batch: DataFrame, history: DataFrame, windows_days: list[int] | None = None) -> DataFrame:
    """The batch rows with trailing counts and totals over batch and history together."""
    days = windows_days or [1, 7, 30]
    measures = velocity_measures(days, F.col("amount"))
    needed = ["user_id", "ts", "amount"]
    past = recent_history(history.select(*needed), batch, max(days))
    found = trailing(batch.select(*needed).unionByName(past), measures).withColumnRenamed("user_id", "_user")
    rows = batch.withColumn("_at", wall_micros(F.col("ts")))
    joined = rows.join(found, (F.col("user_id") == F.col("_user")) & (F.col("_at") == F.col("_t")), "left")
    fill = empty_measures(measures)
    return joined.select(*batch.columns, *[F.coalesce(F.col(m.name), fill[m.name]).alias(m.name) for m in measures])
