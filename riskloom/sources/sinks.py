"""Writers: slot tables, exports, logs and reports. Logs are appended to, never rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.validation import FEEDBACK_LOG_SCHEMA, feedback_records, split
from riskloom.schema import EXPORT_COLUMNS
from riskloom.sources.transactions import slot_name


def write_slots(df: DataFrame, path: str) -> None:
    """Rows by 15-minute slot; writing a slot again replaces just that slot, so retries are safe.

    Rebalancing by slot merges small slots into one task and splits a busy one by size.
    """
    slotted = df if "slot" in df.columns else df.withColumn("slot", slot_name(F.col("ts")))
    spread = slotted.hint("rebalance", "slot")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)


def write_stage(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def export_rows(df: DataFrame) -> DataFrame:
    """The dashboard columns that exist, in their fixed order."""
    return df.select(*[c for c in EXPORT_COLUMNS if c in df.columns])


def export_csv(df: DataFrame, path: str) -> None:
    export_rows(df).write.mode("overwrite").option("header", True).csv(path)


def append_kpis(kpis: DataFrame, path: str) -> None:
    kpis.coalesce(1).write.mode("append").option("header", True).csv(path)


KPI_SCHEMA = (
    "run_timestamp string, batch_size bigint, drift_detected int, n_drifted_features bigint, "
    "fraud_rate double, avg_fraud_score double, avg_anomaly_score double, missing_ratio double"
)


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KPI_SCHEMA).option("header", True).csv(path)


def write_report(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def log_feedback(df: DataFrame, path: str) -> DataFrame:
    """Append valid feedback as JSON lines; returns the rejected rows."""
    valid, rejected = split(feedback_records(df))
    valid.select(*FEEDBACK_LOG_SCHEMA.names).write.mode("append").json(path)
    return rejected


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_LOG_SCHEMA).json(path)
