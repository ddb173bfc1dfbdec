"""Streaming aggregates: tier counts, user velocity, session addresses, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import risk_tier
from riskloom.operators.validation import apply_defaults, from_json_lines, split, to_transactions, validate

LATENESS = "1 hour"


def stream_source(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None, **options
) -> DataFrame:
    """A file (or, by ``fmt`` and options, broker) stream under a fixed schema."""
    reader = spark.readStream.format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load() if fmt == "kafka" else reader.schema(schema).load(path)


def event_time(df: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """``ts`` as an event-time column with a watermark."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def tier_windows(df: DataFrame, score: str = "fraud_score", width: str = "15 minutes") -> DataFrame:
    """Rows, mean score and fraud rate per tumbling window and tier."""
    tiered = df.withColumn("risk_tier", risk_tier(F.col(score)))
    out = tiered.groupBy(F.window("ts", width), "risk_tier").agg(
        F.count("*").alias("n"), F.avg(score).alias("avg_score"), F.avg("is_fraud").alias("fraud_rate")
    )
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "risk_tier", "n", "avg_score", "fraud_rate")


def sliding_velocity(df: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Transactions and amount per user and sliding window; rows merge before the shuffle."""
    out = df.groupBy("user_id", F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return out.select("user_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "total")


def session_addresses(df: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Distinct addresses per user session."""
    out = df.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.size(F.collect_set("ip_address")).cast("bigint").alias("ips"), F.count("*").alias("n")
    )
    return out.select(
        "user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "ips", "n"
    )


def without_retries(df: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """One row per id within the lateness bound."""
    return df.dropDuplicatesWithinWatermark([id_col])


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what the source holds now into an append-only parquet table."""
    query = (
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def run_complete(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what the source holds now and write every group, those the watermark still keeps open too.

    For sources that end: the state holds all groups, and each batch writes the whole result anew.
    """

    def replace(out: DataFrame, batch_id: int) -> None:
        out.write.mode("overwrite").parquet(path)

    writer = df.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def requests_from_broker(df: DataFrame) -> DataFrame:
    """The valid transactions among broker messages."""
    texts = df.select(F.col("value").cast("string").alias("value"))
    return to_transactions(split(validate(apply_defaults(from_json_lines(texts))))[0])
