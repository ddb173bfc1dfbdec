"""Registered queries: sources, validation, features, aggregates, windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalog.base import (
    AMOUNT_SQL,
    CALENDAR_SQL,
    FEATURES,
    SCORED,
    STATS,
    TIER,
    TXN,
    features,
    frames,
    scored,
    scratch,
    with_sql,
)
from riskloom.functions.ordering import ordered_totals, user_quantiles
from riskloom.functions.scalars import (
    align_to_contract,
    calendar_features,
    flag,
    numeric_columns,
    parse_timestamp,
    risk_tier,
    score_label,
)
from riskloom.operators.evidence import attach_explanations, flagged_first, top_contributions
from riskloom.operators.features import FeatureBuilder, FeatureModel, category_frequencies, frequency_lookup, numeric_stats, user_profile
from riskloom.operators.metrics import average_precision, batch_kpis, roc_auc, score_histogram, tier_counts
from riskloom.operators.trailing import velocity_measures, with_trailing
from riskloom.operators.validation import apply_defaults, from_json_lines, outcome_counts, split, validate
from riskloom.plans.scoring import responses
from riskloom.schema import CATEGORY_COLUMNS, FEATURE_COLUMNS, STATS_COLUMNS
from riskloom.sources import sinks
from riskloom.sources.transactions import read_partitioned, read_transactions, slot_start

ALL = """transaction_id, user_id, amount, merchant_category, payment_method, device_type, channel, ts, merchant_id,
  account_age_days, round(credit_utilization, 6) AS credit_utilization, prior_fraud_count, ip_address,
  device_fingerprint, country, status, is_fraud"""


def batch_scan(spark: SparkSession, sf: str) -> DataFrame:
    return read_transactions(spark, sf).withColumn("credit_utilization", F.round("credit_utilization", 6))


def slot_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf)
    out = rows.groupBy(slot_start(F.col("ts")).alias("slot")).agg(
        F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total")
    )
    return out


def slot_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "slots")
    rows = read_transactions(spark, sf)
    # Day-sized slots keep this check from writing thousands of tiny files.
    sinks.write_slots(rows.withColumn("slot", F.date_format("ts", "yyyyMMdd")), path)
    back = read_partitioned(spark, path).withColumn("credit_utilization", F.round("credit_utilization", 6))
    return back.withColumn("slot_day", F.col("slot").cast("string")).drop("slot")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request texts as a client would send them: some fields left out, some out of range."""
    t = read_transactions(spark, sf)
    k = F.col("merchant_id")
    body = F.struct(
        "transaction_id",
        F.when(k != 13, F.col("user_id")).alias("user_id"),
        F.when(k != 17, F.col("amount") - 5).alias("amount"),
        F.when(F.col("merchant_category") != "view", F.col("merchant_category")).alias("merchant_category"),
        F.when(F.col("country") != "CN", F.col("channel")).alias("channel"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(k != 23, F.col("account_age_days") - 100).alias("account_age_days"),
        F.when(k != 29, k.cast("double") / 80).alias("credit_utilization"),
    )
    return t.select(F.to_json(body).alias("value"))


REQUESTS = TXN + """, sent AS (
  SELECT transaction_id,
    CASE WHEN merchant_id <> 13 THEN user_id END AS user_id,
    CASE WHEN merchant_id <> 17 THEN amount - 5 END AS amount,
    CASE WHEN merchant_category <> 'view' THEN merchant_category ELSE 'unknown' END AS merchant_category,
    'unknown' AS payment_method, 'unknown' AS device_type,
    CASE WHEN country <> 'CN' THEN channel ELSE 'online' END AS channel,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp_text,
    CAST(CASE WHEN merchant_id <> 23 THEN account_age_days - 100 ELSE 365 END AS INT) AS account_age_days,
    CASE WHEN merchant_id <> 29 THEN CAST(merchant_id AS DOUBLE) / 80 ELSE 0.3 END AS credit_utilization,
    CAST(0 AS INT) AS prior_fraud_count, false AS explain
  FROM txn
), checked AS (
  SELECT *, concat_ws('; ',
    CASE WHEN user_id IS NULL THEN 'user_id is required.' END,
    CASE WHEN amount IS NULL THEN 'amount is required.' END,
    CASE WHEN amount <= 0 THEN 'amount must be greater than 0.' END,
    CASE WHEN account_age_days < 0 THEN 'account_age_days must be >= 0.' END,
    CASE WHEN credit_utilization NOT BETWEEN 0 AND 1 THEN 'credit_utilization must be 0–1.' END) AS errors
  FROM sent
)"""


def loaded_requests(spark: SparkSession, sf: str) -> DataFrame:
    return apply_defaults(from_json_lines(requests(spark, sf)))


def request_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return loaded_requests(spark, sf).select(
        "transaction_id", "user_id", F.round("amount", 6).alias("amount"), "merchant_category", "payment_method",
        "device_type", "channel", F.col("timestamp").alias("timestamp_text"), "account_age_days",
        F.round("credit_utilization", 6).alias("credit_utilization"), "prior_fraud_count", "explain",
    )


def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    checked = validate(loaded_requests(spark, sf))
    return checked.select("transaction_id", F.array_join("errors", "; ").alias("errors"), "status")


# One kind of request for each remainder of the merchant: how a field is written, and what is wrong with it.
ODD_REQUESTS = [
    ('"amount":"abc"', "amount must be a number.", "NULL", "365"),
    ('"amount":" 12.5 "', "", "12.5", "365"),
    ('"amount":20,"account_age_days":12.7', "", "20", "12"),
    ('"amount":20,"credit_utilization":null', "credit_utilization may not be null.", "20", "365"),
    ('"amount":"Infinity"', "amount must be a finite number.", "NULL", "365"),
    ('"amount":20,"account_age_days":"12.7"', "account_age_days must be a whole number.", "20", "365"),
    ('"amount":20,"account_age_days":"40","merchant_category":5', "merchant_category must be text.", "20", "40"),
    ('"amount":null,"explain":"maybe"', "amount may not be null.; explain must be true or false.", "NULL", "365"),
    ('"amount":true,"timestamp":null', "amount must be a number.", "NULL", "365"),
    ('"amount":-1,"credit_utilization":"high"', "amount must be greater than 0.; credit_utilization must be a number.", "-1", "365"),
    ('"amount":[3],"explain":"yes"', "amount must be a number.", "NULL", "365"),
    ('"explain":1', "amount is required.", "NULL", "365"),
]


def typed_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose fields have wrong types, numbers as text, fractions and explicit nulls."""
    rows = read_transactions(spark, sf).select("transaction_id", "user_id", "merchant_id")
    kinds = F.array(*[F.lit(x) for x, *_ in ODD_REQUESTS])
    odd = F.element_at(kinds, (F.col("merchant_id") % len(ODD_REQUESTS) + 1).cast("int"))
    text = F.concat(F.lit('{"transaction_id":"'), "transaction_id", F.lit('","user_id":'), "user_id", F.lit(","), odd, F.lit("}"))
    checked = validate(apply_defaults(from_json_lines(rows.select(text.alias("value")))))
    amount = F.when(F.abs("amount") < float("inf"), F.col("amount"))
    return checked.select("transaction_id", amount.alias("amount"), "account_age_days", F.array_join("errors", "; ").alias("errors"), "status")


_ODD = " ".join(f"WHEN {i} THEN {{'e': '{e}', 'a': CAST({a} AS DOUBLE), 'g': {g}}}" for i, (_, e, a, g) in enumerate(ODD_REQUESTS))


def request_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return outcome_counts(validate(loaded_requests(spark, sf)))


def rejected_batch(spark: SparkSession, sf: str) -> DataFrame:
    valid, rejected = split(validate(loaded_requests(spark, sf)), reject_batch=True)
    return valid.unionByName(rejected).groupBy("status").agg(F.count("*").alias("requests"))


def feedback_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "feedback")
    rows = scored(spark, sf).select(
        F.when(F.col("merchant_id") != 13, F.col("transaction_id")).alias("transaction_id"),
        risk_tier(F.col("fraud_score")).alias("predicted_tier"),
        F.col("is_fraud").alias("actual_label"),
        F.concat(F.lit("analyst"), F.col("user_id").cast("string")).alias("analyst_id"),
    )
    sinks.log_feedback(rows, path)
    return sinks.read_feedback(spark, path).select(
        "transaction_id", "predicted_tier", "actual_label", "analyst_id",
        (F.length("request_id") == 36).cast("int").alias("has_request_id"),
    )


def dashboard_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    rows = rows.withColumns(calendar_features(F.col("ts"))).withColumn("fraud_label", score_label(F.col("fraud_score")))
    return sinks.export_rows(rows)


CATEGORIES = ["click", "error", "purchase", "signup", "view"]


def kpi_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "kpis")
    rows = scored(spark, sf).withColumn("fraud_label", score_label(F.col("fraud_score")))
    for part in CATEGORIES:
        kpis = batch_kpis(rows.filter(F.col("merchant_category") == part)).select(
            F.lit(part).alias("run_timestamp"), "batch_size", F.lit(0).alias("drift_detected"),
            F.lit(0).cast("bigint").alias("n_drifted_features"), "fraud_rate", "avg_fraud_score", "avg_anomaly_score",
            F.lit(0.0).alias("missing_ratio"),
        )
        sinks.append_kpis(kpis, path)
    log = sinks.read_kpis(spark, path)
    return log.select(
        F.col("run_timestamp").alias("run"), "batch_size",
        *[F.round(c, 6).alias(c) for c in ("fraud_rate", "avg_fraud_score", "avg_anomaly_score")],
    )


def fitted_state(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "state")
    FeatureBuilder().fit(read_transactions(spark, sf)).save(path)
    model = FeatureModel.load(spark, path)
    return model.frequencies.select("column", "value", F.round("freq", 6).alias("freq"))


# -- features -------------------------------------------------------------------------------------

AMOUNT_COLUMNS = ["amount_zscore", "amount_log", "amount_is_round", "amount_above_p95", "amount_above_p99"]
CALENDAR_COLUMNS = ["hour_of_day", "day_of_week", "is_weekend", "is_night", "is_business_hours", "month", "quarter"]


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf).select(
        "transaction_id", "user_id", "ts", "is_fraud", *FEATURE_COLUMNS, "unique_merchants"
    )


def amount_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf).select("transaction_id", "amount")
    return FeatureBuilder().fit_transform(rows).select(
        "transaction_id", F.round("amount_zscore", 6).alias("amount_zscore"), F.round("amount_log", 6).alias("amount_log"),
        *AMOUNT_COLUMNS[2:],
    )


def median_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf).select("transaction_id", "user_id", "amount")
    out = FeatureBuilder().fit_transform(rows)
    return out.select("transaction_id", F.round("amount_vs_user_median", 6).alias("amount_vs_user_median"))


def calendar_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf)
    return rows.select("transaction_id", *[c.alias(n) for n, c in calendar_features(F.col("ts")).items()])


def parsed_times(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("merchant_category") == "error", F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    rows = read_transactions(spark, sf).select("transaction_id", text.alias("text"))
    return rows.select("transaction_id", parse_timestamp(F.col("text")).alias("parsed"))


def repeat_flag(spark: SparkSession, sf: str) -> DataFrame:
    return read_transactions(spark, sf).select(
        "transaction_id", flag(F.col("prior_fraud_count") > 0).alias("is_repeat_fraudster")
    )


def numeric_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf)
    gaps = rows.withColumn("amount", F.when(F.col("merchant_category") != "error", F.col("amount")))
    kept = numeric_columns(gaps)
    return gaps.select("transaction_id", *kept).na.fill(0, kept).withColumn(
        "credit_utilization", F.round("credit_utilization", 6)
    )


def contract_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf).select("transaction_id", "amount", "account_age_days", "prior_fraud_count")
    return align_to_contract(rows, FEATURE_COLUMNS, keep=["transaction_id"])


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("fraud_score")
    return scored(spark, sf).select(
        "transaction_id", F.round(s, 6).alias("fraud_score"), score_label(s).alias("fraud_label"),
        risk_tier(s).alias("risk_tier"),
    )


def rounded_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumns(
        {"fraud_score": F.col("credit_utilization") / 3, "anomaly_score": F.col("amount") / 700}
    )
    rows = rows.withColumns({"fraud_label": score_label(F.col("fraud_score")), "risk_tier": risk_tier(F.col("fraud_score"))})
    return responses(rows)


def ordered_times(spark: SparkSession, sf: str) -> DataFrame:
    """Presentation order by time: each user's transactions numbered in it."""
    rows = read_transactions(spark, sf).select("user_id", "ts", "transaction_id", F.lit(1).alias("one"))
    placed = ordered_totals(rows, ["user_id"], ["ts", "transaction_id"], {"place": "one"})
    return placed.select("transaction_id", "user_id", "place").orderBy("user_id", "place")


def high_risk_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumn("risk_tier", risk_tier(F.col("fraud_score")))
    return rows.filter(F.col("risk_tier") == "HIGH").select("transaction_id", "amount", "fraud_score", "risk_tier")


def flagged_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).agg(
        F.count_if(F.col("fraud_score") >= 0.5).alias("flagged"), F.count_if(F.col("fraud_score") >= 0.7).alias("high_risk")
    )


# -- aggregates -----------------------------------------------------------------------------------


def stats_table(spark: SparkSession, sf: str) -> DataFrame:
    out = numeric_stats(read_transactions(spark, sf), STATS_COLUMNS)
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p95", "p99")])


def line_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = numeric_stats(lines, lines.columns)
    return out.select("column", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p95", "p99")])


def frequency_table(spark: SparkSession, sf: str) -> DataFrame:
    out = category_frequencies(read_transactions(spark, sf), CATEGORY_COLUMNS)
    return out.select("column", "value", "n", F.round("freq", 6).alias("freq"))


def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    return user_profile(read_transactions(spark, sf)).select(
        "user_id", "unique_merchants", "unique_ips", F.col("_countries").alias("countries"), "unique_devices",
        F.round("user_median", 6).alias("user_median"),
    )


def customer_medians(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return user_quantiles(orders, "o_custkey", "o_totalprice", {"median_price": 0.5}).select(
        "o_custkey", F.round("median_price", 4).alias("median_price")
    )


def user_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf).drop("ts")
    out = FeatureBuilder().fit_transform(rows)
    return out.select("transaction_id", "unique_merchants", "unique_ips", "multi_country_session", "unique_devices", "new_device")


def kpis(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumn("fraud_label", score_label(F.col("fraud_score")))
    return batch_kpis(rows).select(
        "batch_size", *[F.round(c, 6).alias(c) for c in ("fraud_rate", "avg_fraud_score", "avg_anomaly_score")]
    )


def label_rate(spark: SparkSession, sf: str) -> DataFrame:
    return read_transactions(spark, sf).agg(
        F.count("*").alias("n"), F.round(F.avg("is_fraud"), 6).alias("fraud_rate")
    )


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return score_histogram(scored(spark, sf)).withColumn("score_sum", F.round("score_sum", 4))


def tier_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumn("risk_tier", risk_tier(F.col("fraud_score")))
    return tier_counts(rows).withColumn("avg_score", F.round("avg_score", 6))


def auc(spark: SparkSession, sf: str) -> DataFrame:
    return roc_auc(scored(spark, sf), "is_fraud", "fraud_score").select(F.round("roc_auc", 6).alias("roc_auc"))


def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    out = average_precision(scored(spark, sf), "is_fraud", "fraud_score")
    return out.select(F.round("average_precision", 6).alias("average_precision"))


def label_auc(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    return roc_auc(docs.join(labels, "doc_id"), "quality", "n_chars").select(F.round("roc_auc", 6).alias("roc_auc"))


# -- windows and joins ----------------------------------------------------------------------------


def velocity(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf).select("transaction_id", "user_id", "ts", "amount")
    out = with_trailing(rows, velocity_measures([1, 7, 30], F.col("amount")))
    return out.drop("user_id", "ts", "amount").withColumns(
        {f"txn_total_{d}d": F.round(f"txn_total_{d}d", 4) for d in (1, 7, 30)}
    )


def velocity_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows with every user treated as heavy, so the split path is checked too."""
    rows = read_transactions(spark, sf).select("transaction_id", "user_id", "ts", "amount")
    out = with_trailing(rows, velocity_measures([3, 14], F.col("amount")), heavy_limit=10)
    return out.drop("user_id", "ts", "amount").withColumns(
        {f"txn_total_{d}d": F.round(f"txn_total_{d}d", 4) for d in (3, 14)}
    )


def frequency_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf)
    known = rows.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    known = known.filter(F.col("merchant_category") != "signup")
    table = category_frequencies(known, CATEGORY_COLUMNS)
    # Five categories by construction of the view.
    return frequency_lookup(rows, "merchant_category", table, small=True).select(
        "transaction_id", F.round("merchant_category_freq", 6).alias("merchant_category_freq")
    )


def explanation_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select("transaction_id", "fraud_score", "amount")
    notes = rows.filter(F.col("fraud_score") >= 0.5).select(
        "transaction_id", F.format_string("score %.2f", F.col("fraud_score")).alias("explanation")
    )
    return attach_explanations(rows, notes).select(
        "transaction_id", (F.col("explanation") != "").cast("int").alias("explained")
    )


def first_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return flagged_first(scored(spark, sf)).select("transaction_id", "fraud_score")


def strongest_signals(spark: SparkSession, sf: str) -> DataFrame:
    t = scored(spark, sf).select(
        "transaction_id",
        F.create_map(
            F.lit("amount_effect"), F.round((F.col("amount") - 50) / 100, 4),
            F.lit("utilization_effect"), F.round(F.col("credit_utilization") - 0.5, 4),
            F.lit("age_effect"), F.round((F.lit(1800) - F.col("account_age_days")) / 3650, 4),
            F.lit("history_effect"), F.round(F.col("prior_fraud_count") / 10, 4),
        ).alias("contributions"),
    )
    top = top_contributions(F.col("contributions"), 3)
    return t.select("transaction_id", F.explode(top).alias("e")).select(
        "transaction_id", F.col("e.feature").alias("feature"), F.col("e.value").alias("value")
    )


QUERIES = {
    "a01_batch_scan": (batch_scan, with_sql(TXN, f"SELECT {ALL} FROM txn")),
    "a02_slot_batches": (
        slot_batches,
        with_sql(TXN, "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS slot, count(*) AS n, round(sum(amount), 4) AS total FROM txn GROUP BY 1"),
    ),
    "a03_slot_sink": (slot_sink, with_sql(TXN, f"SELECT {ALL}, strftime(ts, '%Y%m%d') AS slot_day FROM txn")),
    "a04_request_defaults": (
        request_defaults,
        with_sql(REQUESTS, """SELECT transaction_id, user_id, round(amount, 6) AS amount, merchant_category, payment_method,
  device_type, channel, timestamp_text, account_age_days, round(credit_utilization, 6) AS credit_utilization,
  prior_fraud_count, explain FROM sent"""),
    ),
    "a05_request_validation": (
        request_validation,
        with_sql(REQUESTS, "SELECT transaction_id, errors, CASE WHEN errors = '' THEN 'valid' ELSE 'rejected' END AS status FROM checked"),
    ),
    "a05_reject_whole_batch": (
        rejected_batch,
        with_sql(REQUESTS, "SELECT CASE WHEN (SELECT count(*) FROM checked WHERE errors <> '') > 0 THEN 'rejected' ELSE 'valid' END AS status, count(*) AS requests FROM checked GROUP BY 1"),
    ),
    "a05_typed_requests": (
        typed_requests,
        with_sql(TXN, f"""SELECT transaction_id, x.a AS amount, CAST(x.g AS INT) AS account_age_days, x.e AS errors,
  CASE WHEN x.e = '' THEN 'valid' ELSE 'rejected' END AS status FROM (SELECT transaction_id, CASE merchant_id % {len(ODD_REQUESTS)} {_ODD} END AS x FROM txn)"""),
    ),
    "a06_feedback_log": (
        feedback_log,
        with_sql(SCORED, f"""SELECT transaction_id, {TIER} AS predicted_tier, is_fraud AS actual_label,
  concat('analyst', user_id) AS analyst_id, CAST(1 AS INT) AS has_request_id FROM scored WHERE merchant_id <> 13"""),
    ),
    "a07_dashboard_export": (
        dashboard_export,
        with_sql(SCORED, """SELECT transaction_id, user_id, amount, merchant_category, ts, fraud_score, anomaly_score,
  CAST(fraud_score >= 0.5 AS INT) AS fraud_label, CAST(hour(ts) AS INT) AS hour_of_day,
  CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(hour(ts) < 6 OR hour(ts) >= 22 AS INT) AS is_night FROM scored"""),
    ),
    "a08_e08_kpi_log": (
        kpi_log,
        with_sql(SCORED, """SELECT merchant_category AS run, count(*) AS batch_size,
  round(avg(CAST(fraud_score >= 0.5 AS INT)), 6) AS fraud_rate, round(avg(fraud_score), 6) AS avg_fraud_score,
  round(avg(anomaly_score), 6) AS avg_anomaly_score FROM scored GROUP BY 1"""),
    ),
    "a10_fitted_state": (
        fitted_state,
        with_sql(TXN + STATS, 'SELECT col AS "column", value, round(freq, 6) AS freq FROM freq'),
    ),
    "b00_feature_table": (feature_table, with_sql(FEATURES, "SELECT * FROM features")),
    "b01_b04_amount_features": (amount_columns, with_sql(TXN + STATS, f"SELECT transaction_id, {AMOUNT_SQL} FROM txn CROSS JOIN stats s")),
    "b05_user_median_ratio": (
        median_ratio,
        with_sql(TXN + STATS, "SELECT transaction_id, round(amount / (user_median + 1e-9), 6) AS amount_vs_user_median FROM txn JOIN per_user USING (user_id)"),
    ),
    "b06_b10_calendar_features": (calendar_columns, with_sql(TXN, f"SELECT transaction_id, {CALENDAR_SQL} FROM txn")),
    "b11_parsed_times": (
        parsed_times,
        with_sql(TXN, "SELECT transaction_id, CASE WHEN merchant_category <> 'error' THEN ts END AS parsed FROM txn"),
    ),
    "b12_repeat_flag": (
        repeat_flag,
        with_sql(TXN, "SELECT transaction_id, CAST(prior_fraud_count > 0 AS INT) AS is_repeat_fraudster FROM txn"),
    ),
    "b13_b14_numeric_matrix": (
        numeric_matrix,
        with_sql(TXN, """SELECT transaction_id, CASE WHEN merchant_category <> 'error' THEN amount ELSE 0 END AS amount,
  account_age_days, round(credit_utilization, 6) AS credit_utilization, prior_fraud_count FROM txn"""),
    ),
    "b15_contract_matrix": (
        contract_matrix,
        with_sql(TXN, "SELECT transaction_id, CAST(amount AS DOUBLE) AS amount, CAST(account_age_days AS DOUBLE) AS account_age_days, "
                 "CAST(0 AS DOUBLE) AS credit_utilization, CAST(prior_fraud_count AS DOUBLE) AS prior_fraud_count, "
                 + ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in FEATURE_COLUMNS[4:]) + " FROM txn"),
    ),
    "b16_b17_labels_and_tiers": (
        tiers,
        with_sql(SCORED, f"SELECT transaction_id, fraud_score, CAST(fraud_score >= 0.5 AS INT) AS fraud_label, {TIER} AS risk_tier FROM scored"),
    ),
    "b18_flagged_counts": (
        flagged_counts,
        with_sql(SCORED, "SELECT count(*) FILTER (fraud_score >= 0.5) AS flagged, count(*) FILTER (fraud_score >= 0.7) AS high_risk FROM scored"),
    ),
    "b19_tier_slice": (
        high_risk_slice,
        with_sql(SCORED, "SELECT transaction_id, amount, fraud_score, 'HIGH' AS risk_tier FROM scored WHERE fraud_score >= 0.7 AND fraud_score < 0.9"),
    ),
    "b20_rounded_responses": (
        rounded_responses,
        with_sql(TXN, f""", scored AS (SELECT transaction_id, credit_utilization / 3 AS fraud_score, amount / 700 AS anomaly_score FROM txn)
SELECT transaction_id, round(fraud_score, 6) AS fraud_score, round(anomaly_score, 6) AS anomaly_score,
  CAST(fraud_score >= 0.5 AS INT) AS fraud_label, {TIER} AS risk_tier, '' AS explanation FROM scored"""),
    ),
    "e05_time_order": (
        ordered_times,
        with_sql(TXN, "SELECT transaction_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, transaction_id) AS place FROM txn"),
    ),
    "c01_numeric_stats": (
        stats_table,
        with_sql(TXN, "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}) + 1e-9, 6) AS std,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST({c} AS DOUBLE), 0.99), 6) AS p99 FROM txn"""
            for c in STATS_COLUMNS)),
    ),
    "c01_line_stats": (
        line_stats,
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)) + 1e-9, 4) AS std,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 4) AS p95, round(quantile_cont(CAST({c} AS DOUBLE), 0.99), 4) AS p99 FROM lineitem"""
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    ),
    "c02_category_frequencies": (
        frequency_table,
        with_sql(TXN + STATS, 'SELECT col AS "column", value, n, round(freq, 6) AS freq FROM freq'),
    ),
    "c03_c07_user_profile": (
        profile_table,
        with_sql(TXN + STATS, "SELECT user_id, unique_merchants, unique_ips, countries, unique_devices, round(user_median, 6) AS user_median FROM per_user"),
    ),
    "c05_c06_d03_e03_user_flags": (
        user_flags,
        with_sql(TXN + STATS, """SELECT transaction_id, unique_merchants, unique_ips, CAST(countries > 1 AS INT) AS multi_country_session,
  unique_devices, CAST(unique_devices > 3 AS INT) AS new_device FROM txn JOIN per_user USING (user_id)"""),
    ),
    "c07_customer_medians": (
        customer_medians,
        "SELECT o_custkey, round(median(CAST(o_totalprice AS DOUBLE)), 4) AS median_price FROM orders GROUP BY 1",
    ),
    "c08_batch_kpis": (
        kpis,
        with_sql(SCORED, """SELECT count(*) AS batch_size, round(avg(CAST(fraud_score >= 0.5 AS INT)), 6) AS fraud_rate,
  round(avg(fraud_score), 6) AS avg_fraud_score, round(avg(anomaly_score), 6) AS avg_anomaly_score FROM scored"""),
    ),
    "c09_label_rate": (label_rate, with_sql(TXN, "SELECT count(*) AS n, round(avg(is_fraud), 6) AS fraud_rate FROM txn")),
    "c10_score_histogram": (
        histogram,
        with_sql(SCORED, "\nUNION ALL\n".join(
            f"SELECT '{label}' AS le, count(*) FILTER ({cond}) AS n, count(*) AS total, round(sum(fraud_score), 4) AS score_sum FROM scored"
            for label, cond in [(str(i / 10), f"fraud_score <= CAST({i / 10} AS DOUBLE)") for i in range(11)] + [("+Inf", "true")])),
    ),
    "c11_request_outcomes": (
        request_outcomes,
        with_sql(REQUESTS, "SELECT CASE WHEN errors = '' THEN 'valid' ELSE 'rejected' END AS status, count(*) AS requests FROM checked GROUP BY 1"),
    ),
    "c12_roc_auc": (
        auc,
        with_sql(SCORED, """, g AS (SELECT fraud_score AS s, sum(is_fraud) AS pos, count(*) - sum(is_fraud) AS neg FROM scored GROUP BY 1),
r AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM g)
SELECT round(sum(CAST(pos AS DOUBLE) * (below + CAST(0.5 AS DOUBLE) * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS roc_auc FROM r"""),
    ),
    "c12_quality_auc": (
        label_auc,
        """WITH j AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
g AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM j GROUP BY 1),
r AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM g)
SELECT round(sum(CAST(pos AS DOUBLE) * (below + CAST(0.5 AS DOUBLE) * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS roc_auc FROM r""",
    ),
    "c13_average_precision": (
        avg_precision,
        with_sql(SCORED, """, g AS (SELECT fraud_score AS s, sum(is_fraud) AS pos, count(*) AS n FROM scored GROUP BY 1),
r AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM g)
SELECT round(sum(CAST(pos AS DOUBLE) * tp / seen) / CAST(sum(pos) AS DOUBLE), 6) AS average_precision FROM r"""),
    ),
    "c14_tier_counts": (
        tier_table,
        with_sql(SCORED, f"SELECT {TIER} AS risk_tier, count(*) AS n, round(avg(fraud_score), 6) AS avg_score FROM scored GROUP BY 1"),
    ),
    "d01_d02_velocity": (velocity, with_sql(TXN, f"SELECT transaction_id, {frames()} FROM txn")),
    "d01_velocity_heavy_split": (velocity_split, with_sql(TXN, f"SELECT transaction_id, {frames([3, 14])} FROM txn")),
    "e01_frequency_lookup": (
        frequency_join,
        with_sql(TXN, """, known AS (SELECT * FROM txn WHERE ts < TIMESTAMP '2024-01-16' AND merchant_category <> 'signup'),
f AS (SELECT merchant_category, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM known) AS freq FROM known GROUP BY 1)
SELECT transaction_id, round(coalesce(freq, 0), 6) AS merchant_category_freq FROM txn LEFT JOIN f USING (merchant_category)"""),
    ),
    "e02_explanation_attach": (
        explanation_join,
        with_sql(SCORED, "SELECT transaction_id, CAST(fraud_score >= 0.5 AS INT) AS explained FROM scored"),
    ),
    "e06_first_flagged": (
        first_flagged,
        with_sql(SCORED, "SELECT transaction_id, fraud_score FROM scored WHERE fraud_score >= 0.5 ORDER BY fraud_score DESC, transaction_id LIMIT 50"),
    ),
    "e07_strongest_signals": (
        strongest_signals,
        with_sql(TXN, """, c AS (
  SELECT transaction_id, 'amount_effect' AS feature, round((amount - 50) / CAST(100 AS DOUBLE), 4) AS value FROM txn
  UNION ALL SELECT transaction_id, 'utilization_effect', round(credit_utilization - CAST(0.5 AS DOUBLE), 4) FROM txn
  UNION ALL SELECT transaction_id, 'age_effect', round((1800 - account_age_days) / CAST(3650 AS DOUBLE), 4) FROM txn
  UNION ALL SELECT transaction_id, 'history_effect', round(prior_fraud_count / CAST(10 AS DOUBLE), 4) FROM txn)
SELECT transaction_id, feature, value FROM c QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY abs(value) DESC, feature) <= 3"""),
    ),
}
