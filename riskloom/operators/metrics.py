"""Batch KPIs, score histogram, tier counts and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import ordered_totals

HISTOGRAM_BOUNDS = [i / 10 for i in range(11)]


def batch_kpis(df: DataFrame) -> DataFrame:
    """One row; a KPI whose column is absent is null."""

    def mean(column: str, name: str):
        return (F.avg(column) if column in df.columns else F.lit(None).cast("double")).alias(name)

    return df.agg(
        F.count("*").alias("batch_size"),
        mean("fraud_label", "fraud_rate"),
        mean("fraud_score", "avg_fraud_score"),
        mean("anomaly_score", "avg_anomaly_score"),
    )


def tier_counts(df: DataFrame, tier: str = "risk_tier", score: str = "fraud_score") -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score"))


def score_histogram(df: DataFrame, score: str = "fraud_score") -> DataFrame:
    """Cumulative buckets: rows with score <= bound, last bound +Inf; with overall sum and count."""
    counts = df.agg(
        *[F.count_if(F.col(score) <= b).alias(f"b{i}") for i, b in enumerate(HISTOGRAM_BOUNDS)],
        F.count(score).alias("total"),
        F.sum(score).alias("score_sum"),
    )
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(HISTOGRAM_BOUNDS)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return counts.select(F.explode(F.array(*rows)).alias("r"), "total", "score_sum").select(
        "r.le", "r.n", "total", "score_sum"
    )


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    positive = F.col(label) > 0
    return (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs ranked rightly, ties one half; null without both classes."""
    ranked = ordered_totals(_by_score(df, label, score), [], ["score"], {"neg_upto": "neg"})
    below = F.col("neg_upto") - F.col("neg")
    # Doubles: pair counts outgrow 64-bit integers.
    won = F.sum(F.col("pos").cast("double") * (below.cast("double") + F.lit(0.5).cast("double") * F.col("neg")))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(won, pairs).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision summed over the recall steps, highest score first."""
    ranked = ordered_totals(
        _by_score(df, label, score).withColumn("all", F.col("pos") + F.col("neg")),
        [],
        ["score"],
        {"tp": "pos", "seen": "all"},
        descending=True,
    )
    gain = F.sum(F.col("pos").cast("double") * F.col("tp") / F.col("seen"))
    return ranked.agg(F.try_divide(gain, F.sum("pos").cast("double")).alias("average_precision"))


def ranking_metrics(df: DataFrame, label: str, score: str, prefix: str) -> DataFrame:
    """(metric, value) rows for one data split."""
    auc = roc_auc(df, label, score).select(F.lit(f"{prefix}_auc_roc").alias("metric"), F.col("roc_auc").alias("value"))
    ap = average_precision(df, label, score)
    return auc.unionByName(
        ap.select(F.lit(f"{prefix}_avg_precision").alias("metric"), F.col("average_precision").alias("value"))
    )
