"""Readers: batches, time slots, and the transaction view over an event table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import MICROS_PER_SECOND, nan_to_null, wall_micros, wall_time
from riskloom.schema import TRANSACTION_SCHEMA

SLOT_MINUTES = 15


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """A parquet batch under the fixed schema: no inference, column-pruned, filters pushed down."""
    return nan_to_null(spark.read.schema(TRANSACTION_SCHEMA).parquet(path))


def read_slot(spark: SparkSession, path: str, slot: str) -> DataFrame:
    """One 15-minute slot of a table written by ``sinks.write_slots`` (partition-pruned)."""
    return read_partitioned(spark, path).filter(F.col("slot") == slot)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*TRANSACTION_SCHEMA.fields, T.StructField("slot", T.StringType())])
    return nan_to_null(spark.read.schema(schema).parquet(path))


def slot_start(ts: Column) -> Column:
    """Start of the 15-minute slot a wall-clock time falls in."""
    width = SLOT_MINUTES * 60 * MICROS_PER_SECOND
    return wall_time(F.floor(wall_micros(ts) / width) * width)


def slot_name(ts: Column) -> Column:
    minute = F.floor(F.minute(ts) / SLOT_MINUTES) * SLOT_MINUTES
    return F.format_string("%04d%02d%02d_%02d%02d", F.year(ts), F.month(ts), F.day(ts), F.hour(ts), minute)


def slice_slot(df: DataFrame, start: dt.datetime, minutes: int = SLOT_MINUTES) -> DataFrame:
    """Rows of one slot by a plain range on ``ts``, which reaches the parquet scan."""
    end = start + dt.timedelta(minutes=minutes)
    return df.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def transactions_from_events(events: DataFrame) -> DataFrame:
    """The transaction table derived from raw events by arithmetic alone."""
    e = events.select(
        "event_id", "user_id", "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    eid, uid, k = F.col("event_id"), F.col("user_id"), F.col("k")
    text_id = eid.cast("string")
    pick = lambda column, *names: F.element_at(F.array(*map(F.lit, names)), (column + 1).cast("int"))
    return e.select(
        # Padded to seven digits; longer ids keep all of theirs.
        F.concat(F.lit("TXN"), F.lpad(text_id, F.greatest(F.length(text_id), F.lit(7)), F.lit("0"))).alias("transaction_id"),
        uid.alias("user_id"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("merchant_category"),
        pick(eid % 4, "credit", "debit", "wire", "crypto").alias("payment_method"),
        pick(eid % 3, "mobile", "desktop", "tablet").alias("device_type"),
        pick(k % 3, "online", "pos", "mobile_app").alias("channel"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        k.cast("bigint").alias("merchant_id"),
        ((uid * 37) % 3650 + 1).cast("int").alias("account_age_days"),
        (k.cast("double") / F.lit(99).cast("double")).alias("credit_utilization"),
        F.when(uid % 6 == 4, 1).when(uid % 6 == 5, 2).otherwise(0).cast("int").alias("prior_fraud_count"),
        F.concat(F.lit("192.168."), (k % 8).cast("string"), F.lit("."), (uid % 250).cast("string")).alias("ip_address"),
        F.concat(F.lit("DEV"), (1000 + k % 7).cast("string")).alias("device_fingerprint"),
        pick(k % 6, "US", "US", "US", "GB", "CN", "NG").alias("country"),
        F.when(F.col("event_type") == "error", "declined").otherwise("approved").alias("status"),
        F.when(F.col("value") + 2 * k >= 320, 1).otherwise(0).cast("int").alias("is_fraud"),
    )


def read_transactions(spark: SparkSession, directory: str) -> DataFrame:
    return transactions_from_events(spark.read.parquet(f"{directory}/events.parquet"))
