"""Transaction schema, defaults and the ordered feature contracts."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names, defaults, contracts and tier bounds -------------------------

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("account_age_days", T.IntegerType()),
        T.StructField("credit_utilization", T.DoubleType()),
        T.StructField("prior_fraud_count", T.IntegerType()),
        T.StructField("explain", T.BooleanType()),
        T.StructField("merchant_id", T.LongType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("device_fingerprint", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)

REQUEST_DEFAULTS = {
    "merchant_category": "unknown",
    "payment_method": "unknown",
    "device_type": "unknown",
    "channel": "online",
    "account_age_days": 365,
    "credit_utilization": 0.3,
    "prior_fraud_count": 0,
    "explain": False,
}

FEEDBACK_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("predicted_tier", T.StringType()),
        T.StructField("actual_label", T.IntegerType()),
        T.StructField("analyst_id", T.StringType()),
    ]
)

# The canonical table: a parsed wall-clock ``ts`` in place of the request's text timestamp.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("merchant_id", T.LongType()),
        T.StructField("account_age_days", T.IntegerType()),
        T.StructField("credit_utilization", T.DoubleType()),
        T.StructField("prior_fraud_count", T.IntegerType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("device_fingerprint", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("is_fraud", T.IntegerType()),
    ]
)

CATEGORY_COLUMNS = ["merchant_category", "payment_method", "device_type", "channel"]
STATS_COLUMNS = ["amount", "account_age_days", "credit_utilization", "prior_fraud_count"]

FEATURE_COLUMNS = [
    "amount",
    "account_age_days",
    "credit_utilization",
    "prior_fraud_count",
    "amount_zscore",
    "amount_log",
    "amount_is_round",
    "amount_above_p95",
    "amount_above_p99",
    "amount_vs_user_median",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_night",
    "is_business_hours",
    "month",
    "quarter",
    "txn_count_1d",
    "txn_total_1d",
    "txn_count_7d",
    "txn_total_7d",
    "txn_count_30d",
    "txn_total_30d",
    "merchant_category_freq",
    "payment_method_freq",
    "device_type_freq",
    "channel_freq",
    "unique_ips",
    "is_repeat_fraudster",
    "multi_country_session",
    "unique_devices",
    "new_device",
]
AUGMENTED_COLUMNS = FEATURE_COLUMNS + ["anomaly_score"]

# Columns that never enter a model even when numeric.
NON_FEATURES = {
    "is_fraud",
    "transaction_id",
    "user_id",
    "timestamp",
    "ts",
    "merchant_id",
    "ip_address",
    "device_fingerprint",
    "country",
    "explain",
    "merchant_category",
    "payment_method",
    "device_type",
    "channel",
}

TIER_BOUNDS = {"CRITICAL": 0.90, "HIGH": 0.70, "MEDIUM": 0.50, "LOW": 0.30}

EXPORT_COLUMNS = [
    "transaction_id",
    "user_id",
    "amount",
    "merchant_category",
    "ts",
    "fraud_score",
    "anomaly_score",
    "fraud_label",
    "is_anomaly",
    "hour_of_day",
    "is_weekend",
    "is_night",
]
# ---------------------------------------------------------------------------------------------
