"""One monitoring run: reference handling, drift summary, exports and KPI log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.drift import drift_summary, load_reference, set_reference
from riskloom.operators.metrics import batch_kpis
from riskloom.session import pin
from riskloom.sources.sinks import append_kpis, export_csv, write_report


class DriftMonitor:
    def __init__(self, directory: str, drift_threshold: float = 0.15, score_shift_threshold: float = 0.05, rule: str = "share"):
        self.directory = directory
        self.drift_threshold, self.score_shift_threshold, self.rule = drift_threshold, score_shift_threshold, rule

    @property
    def reference_path(self) -> str:
        return f"{self.directory}/reference"

    def run(self, current: DataFrame, columns: list[str] | None = None, run_name: str | None = None) -> DataFrame:
        """The one-row summary. The first run stores the batch as reference and reports no drift."""
        spark = current.sparkSession
        stamp = spark.sql("SELECT date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'yyyyMMdd_HHmmss')")
        name = run_name or f"{stamp.first()[0]}_{uuid.uuid4().hex[:8]}"  # two runs may share a second
        reference = load_reference(spark, self.reference_path)
        if reference is None:
            set_reference(current, self.reference_path)
            return spark.sql("SELECT false AS drift_detected, 'first run: kept as the reference' AS reason")
        summary = drift_summary(reference, current, columns, self.drift_threshold, self.score_shift_threshold, self.rule)
        summary = pin(summary.withColumn("run_timestamp", F.lit(name)))
        export_csv(current, f"{self.directory}/transactions/{name}")
        kpis = summary.crossJoin(batch_kpis(current).drop("batch_size"))  # two single rows
        append_kpis(
            kpis.select(
                "run_timestamp", "batch_size", F.col("drift_detected").cast("int").alias("drift_detected"),
                F.col("n_drifted").alias("n_drifted_features"), "fraud_rate", "avg_fraud_score", "avg_anomaly_score", "missing_ratio",
            ),
            f"{self.directory}/kpis",
        )
        write_report(summary, f"{self.directory}/reports/{name}")
        return summary
