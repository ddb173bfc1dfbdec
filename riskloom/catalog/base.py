"""Shared pieces of the registered queries: the transaction view in both dialects."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.features import FeatureBuilder
from riskloom.session import checkpoint_root
from riskloom.sources.transactions import read_transactions

TXN = """
raw AS (
  SELECT event_id, user_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
), txn AS (
  SELECT
    concat('TXN', lpad(CAST(event_id AS VARCHAR), CAST(greatest(7, length(CAST(event_id AS VARCHAR))) AS INT), '0')) AS transaction_id,
    user_id,
    value AS amount,
    event_type AS merchant_category,
    CASE event_id % 4 WHEN 0 THEN 'credit' WHEN 1 THEN 'debit' WHEN 2 THEN 'wire' ELSE 'crypto' END AS payment_method,
    CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
    CASE k % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'pos' ELSE 'mobile_app' END AS channel,
    ts,
    CAST(k AS BIGINT) AS merchant_id,
    CAST((user_id * 37) % 3650 + 1 AS INT) AS account_age_days,
    CAST(k AS DOUBLE) / CAST(99 AS DOUBLE) AS credit_utilization,
    CAST(CASE user_id % 6 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS INT) AS prior_fraud_count,
    concat('192.168.', CAST(k % 8 AS VARCHAR), '.', CAST(user_id % 250 AS VARCHAR)) AS ip_address,
    concat('DEV', CAST(1000 + k % 7 AS VARCHAR)) AS device_fingerprint,
    CASE WHEN k % 6 <= 2 THEN 'US' WHEN k % 6 = 3 THEN 'GB' WHEN k % 6 = 4 THEN 'CN' ELSE 'NG' END AS country,
    CASE WHEN event_type = 'error' THEN 'declined' ELSE 'approved' END AS status,
    CAST(CASE WHEN value + 2 * k >= 320 THEN 1 ELSE 0 END AS INT) AS is_fraud
  FROM raw
)"""

# A plain score of the row's own columns, for queries that need one but no trained model.
SCORE = "round(least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) * credit_utilization + amount / CAST(400 AS DOUBLE)), 6)"
SCORED = TXN + f""", scored AS (SELECT *, {SCORE} AS fraud_score, round(credit_utilization, 6) AS anomaly_score FROM txn)"""
TIER = """CASE WHEN fraud_score >= 0.9 THEN 'CRITICAL' WHEN fraud_score >= 0.7 THEN 'HIGH'
  WHEN fraud_score >= 0.5 THEN 'MEDIUM' WHEN fraud_score >= 0.3 THEN 'LOW' ELSE 'CLEAN' END"""

STATS = """, stats AS (
  SELECT avg(amount) AS mean, stddev_samp(amount) + 1e-9 AS std,
    quantile_cont(amount, 0.95) AS p95, quantile_cont(amount, 0.99) AS p99 FROM txn
), per_user AS (
  SELECT user_id, median(amount) AS user_median, count(DISTINCT merchant_id) AS unique_merchants,
    count(DISTINCT ip_address) AS unique_ips, count(DISTINCT country) AS countries,
    count(DISTINCT device_fingerprint) AS unique_devices
  FROM txn GROUP BY user_id
), freqs AS (
  SELECT 'merchant_category' AS col, merchant_category AS value, count(*) AS n FROM txn GROUP BY 2
  UNION ALL SELECT 'payment_method', payment_method, count(*) FROM txn GROUP BY 2
  UNION ALL SELECT 'device_type', device_type, count(*) FROM txn GROUP BY 2
  UNION ALL SELECT 'channel', channel, count(*) FROM txn GROUP BY 2
), freq AS (SELECT col, value, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY col) AS freq FROM freqs)"""

_FRAME = "(PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
_FREQ = "coalesce((SELECT freq FROM freq f WHERE f.col = '{0}' AND f.value = t.{0}), 0)"


def frames(days: list[int] = (1, 7, 30)) -> str:
    return ",\n".join(
        f"count(*) OVER {_FRAME.format(d)} AS txn_count_{d}d, "
        f"round(coalesce(sum(amount) OVER {_FRAME.format(d)}, 0), 4) AS txn_total_{d}d"
        for d in days
    )


CALENDAR_SQL = """CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
  CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(hour(ts) < 6 OR hour(ts) >= 22 AS INT) AS is_night,
  CAST(hour(ts) BETWEEN 9 AND 17 AND isodow(ts) < 6 AS INT) AS is_business_hours,
  CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter"""

AMOUNT_SQL = """round((amount - s.mean) / s.std, 6) AS amount_zscore, round(ln(1 + amount), 6) AS amount_log,
  CAST(amount % 1 = 0 AS INT) AS amount_is_round, CAST(amount > s.p95 AS INT) AS amount_above_p95,
  CAST(amount > s.p99 AS INT) AS amount_above_p99"""

FEATURES = (
    TXN
    + STATS
    + f""", moving AS (SELECT transaction_id, {frames()} FROM txn
), features AS (
  SELECT t.transaction_id, t.user_id, t.ts, t.is_fraud, t.amount, t.account_age_days,
    round(t.credit_utilization, 6) AS credit_utilization, t.prior_fraud_count,
    {AMOUNT_SQL}, round(amount / (u.user_median + 1e-9), 6) AS amount_vs_user_median, {CALENDAR_SQL},
    m.txn_count_1d, m.txn_total_1d, m.txn_count_7d, m.txn_total_7d, m.txn_count_30d, m.txn_total_30d,
    """
    + ", ".join(
        f"round(q{i}.freq, 6) AS {c}_freq"
        for i, c in enumerate(["merchant_category", "payment_method", "device_type", "channel"])
    )
    + """, u.unique_merchants, u.unique_ips, CAST(t.prior_fraud_count > 0 AS INT) AS is_repeat_fraudster,
    CAST(u.countries > 1 AS INT) AS multi_country_session, u.unique_devices,
    CAST(u.unique_devices > 3 AS INT) AS new_device
  FROM txn t CROSS JOIN stats s JOIN per_user u USING (user_id) JOIN moving m USING (transaction_id)
  """
    + " ".join(
        f"LEFT JOIN freq q{i} ON q{i}.col = '{c}' AND q{i}.value = t.{c}"
        for i, c in enumerate(["merchant_category", "payment_method", "device_type", "channel"])
    )
    + ")"
)

ROUNDED = {
    6: ["credit_utilization", "amount_zscore", "amount_log", "amount_vs_user_median"]
    + [f"{c}_freq" for c in ("merchant_category", "payment_method", "device_type", "channel")],
    4: [f"txn_total_{d}d" for d in (1, 7, 30)],
}


def with_sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def demo_score() -> Column:
    raw = F.lit(0.5) * F.col("credit_utilization") + F.col("amount") / F.lit(400.0)
    return F.round(F.least(F.lit(1.0), raw), 6)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return read_transactions(spark, sf).withColumns(
        {"fraud_score": demo_score(), "anomaly_score": F.round("credit_utilization", 6)}
    )


def features(spark: SparkSession, sf: str, raw: bool = False) -> DataFrame:
    out = FeatureBuilder().fit_transform(read_transactions(spark, sf))
    if raw:
        return out
    return out.withColumns({c: F.round(c, d) for d, cols in ROUNDED.items() for c in cols})


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for tables a query writes."""
    return f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
