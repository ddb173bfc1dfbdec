"""Registered queries: each stream is run over what its source holds and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalog.base import SCORED, TIER, TXN, demo_score, frames, scratch, with_sql
from riskloom.catalog.tabular import ALL
from riskloom.functions.scalars import risk_tier
from riskloom.sources.transactions import read_transactions, transactions_from_events
from riskloom.streaming import windows
from riskloom.streaming.history import velocity_with_history
from riskloom.streaming.micro_batch import against_history, run_batches, score_stream

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    events = windows.stream_source(spark, sf, _parse_datatype_string(EVENT_SCHEMA), pathGlobFilter="events.parquet")
    return transactions_from_events(events).withColumns(
        {"fraud_score": demo_score(), "anomaly_score": F.round("credit_utilization", 6)}
    )


def collected(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path, state = scratch(spark, name), scratch(spark, f"{name}-state")
    windows.run_available(stream, path, state)
    return spark.read.schema(stream.schema).parquet(path)


def as_wall(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def streamed_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = collected(spark, arriving(spark, sf).drop("fraud_score", "anomaly_score"), "rows")
    return out.withColumn("credit_utilization", F.round("credit_utilization", 6))


def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    path, state = scratch(spark, "scored"), scratch(spark, "scored-state")
    tiered = lambda batch: batch.select("transaction_id", "fraud_score", risk_tier(F.col("fraud_score")).alias("risk_tier"))
    score_stream(arriving(spark, sf), tiered, path, state, available_now=True).awaitTermination()
    return spark.read.parquet(path).select("transaction_id", "fraud_score", "risk_tier")


ARRIVALS = ["2024-01-16", "2024-01-19", "2024-01-22", "2024-01-25", "2024-01-28"]  # first day of each batch


def arriving_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """The rows from the first arrival on come in batches, each measured against all before it."""
    source, path, store, state = (scratch(spark, f"velocity-{n}") for n in ("source", "out", "store", "state"))
    rows = read_transactions(spark, sf).select("transaction_id", "user_id", "ts", "amount")
    days = [F.lit(d).cast("timestamp_ntz") for d in ARRIVALS]
    handle = against_history(velocity_with_history, path, store, rows.filter(F.col("ts") < days[0]))
    for first, last in zip(days, [*days[1:], F.lit("9999-01-01").cast("timestamp_ntz")]):
        rows.filter((F.col("ts") >= first) & (F.col("ts") < last)).write.mode("append").parquet(source)
        stream = windows.stream_source(spark, source, rows.schema)
        run_batches(stream, handle, state, available_now=True).awaitTermination()
    out = spark.read.parquet(path).drop("batch_id", "user_id", "ts", "amount")
    return out.withColumns({f"txn_total_{d}d": F.round(f"txn_total_{d}d", 4) for d in (1, 7, 30)})


def finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path, state = scratch(spark, name), scratch(spark, f"{name}-state")
    windows.run_complete(stream, path, state)
    return spark.read.schema(stream.schema).parquet(path)


def tier_windows(spark: SparkSession, sf: str, run=collected) -> DataFrame:
    out = run(spark, windows.tier_windows(windows.event_time(arriving(spark, sf))), "tiers")
    return as_wall(out, "window_start", "window_end").withColumns(
        {"score_sum": F.round(F.col("avg_score") * F.col("n"), 6), "fraud_rate": F.round("fraud_rate", 6)}
    ).drop("avg_score")


def sliding(spark: SparkSession, sf: str, run=collected) -> DataFrame:
    out = run(spark, windows.sliding_velocity(windows.event_time(arriving(spark, sf))), "sliding")
    return as_wall(out, "window_start", "window_end").withColumn("total", F.round("total", 4))


def session_table(spark: SparkSession, sf: str, run=collected) -> DataFrame:
    out = run(spark, windows.session_addresses(windows.event_time(arriving(spark, sf))), "sessions")
    return as_wall(out, "session_start", "session_end")


def all_tier_windows(spark: SparkSession, sf: str) -> DataFrame:
    return tier_windows(spark, sf, finished)


def all_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return sliding(spark, sf, finished)


def all_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return session_table(spark, sf, finished)


def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Every row sent twice; one of each is kept."""
    twice = arriving(spark, sf).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).drop("attempt")
    once = windows.without_retries(windows.event_time(twice))
    return collected(spark, once.select("transaction_id", "user_id", "amount"), "once")


_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM txn)"

_TIERS = f""", w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, {TIER} AS risk_tier, fraud_score, is_fraud FROM scored)
SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, risk_tier, count(*) AS n, round(sum(fraud_score), 6) AS score_sum,
  round(avg(is_fraud), 6) AS fraud_rate FROM w {{}} GROUP BY 1, 2, 3"""
_SLIDING = """, w AS (SELECT user_id, amount, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS window_start FROM txn, range(0, 4) r(k))
SELECT user_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(amount), 4) AS total FROM w
{} GROUP BY 1, 2, 3"""
_SESSIONS = """, o AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS INT) AS opens FROM txn),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM o),
g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(DISTINCT ip_address) AS ips, count(*) AS n FROM s GROUP BY user_id, session)
SELECT * FROM g {}"""

QUERIES = {
    "j01_streamed_rows": (streamed_rows, with_sql(TXN, f"SELECT {ALL} FROM txn")),
    "j02_micro_batches": (micro_batches, with_sql(SCORED, f"SELECT transaction_id, fraud_score, {TIER} AS risk_tier FROM scored")),
    "j03_arriving_velocity": (
        arriving_velocity,
        with_sql(TXN, f", v AS (SELECT transaction_id, ts, {frames()} FROM txn) SELECT * EXCLUDE (ts) FROM v WHERE ts >= TIMESTAMP '2024-01-16'"),
    ),
    "j04_tier_windows": (tier_windows, with_sql(SCORED, _TIERS.format(f"WHERE window_start + INTERVAL 15 MINUTE <= {_MARK}"))),
    "j05_sliding_velocity": (sliding, with_sql(TXN, _SLIDING.format(f"WHERE window_start + INTERVAL 1 HOUR <= {_MARK}"))),
    "j06_session_addresses": (session_table, with_sql(TXN, _SESSIONS.format(f"WHERE session_end <= {_MARK}"))),
    "j04_all_tier_windows": (all_tier_windows, with_sql(SCORED, _TIERS.format(""))),
    "j05_all_sliding_velocity": (all_sliding, with_sql(TXN, _SLIDING.format(""))),
    "j06_all_session_addresses": (all_sessions, with_sql(TXN, _SESSIONS.format(""))),
    "j07_retries_dropped": (deduplicated, with_sql(TXN, "SELECT transaction_id, user_id, amount FROM txn")),
}
