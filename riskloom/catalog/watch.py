"""Registered queries: drift and data quality, policy rules and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalog.base import SCORED, TXN, scored, scratch, with_sql
from riskloom.operators import drift, rules
from riskloom.sources import sinks
from riskloom.sources.transactions import read_transactions

SPLIT = "2024-01-16"
DRIFT_COLUMNS = ["amount", "account_age_days", "credit_utilization", "prior_fraud_count", "merchant_id"]


def drift_pair(spark: SparkSession, sf: str, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    rows = scored(spark, sf)
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    reference, current = rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut)
    if stretch != 1.0:
        current = current.withColumn("amount", F.col("amount") * stretch)
    return reference, current


def _pair_sql(stretch: float = 1.0) -> str:
    moved = f"amount * CAST({stretch} AS DOUBLE)" if stretch != 1.0 else "amount"
    long = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS col, CAST({moved if c == 'amount' else c} AS DOUBLE) AS v, 1 AS cur FROM scored WHERE ts >= TIMESTAMP '{SPLIT}'
  UNION ALL SELECT '{c}', CAST({c} AS DOUBLE), 0 FROM scored WHERE ts < TIMESTAMP '{SPLIT}'"""
        for c in DRIFT_COLUMNS
    )
    return SCORED + f""", long AS ({long}),
g AS (SELECT col, v, count(*) FILTER (cur = 0) AS r, count(*) FILTER (cur = 1) AS c FROM long GROUP BY 1, 2),
w AS (SELECT col, sum(r) OVER (PARTITION BY col ORDER BY v) AS rr, sum(c) OVER (PARTITION BY col ORDER BY v) AS cc,
  sum(r) OVER (PARTITION BY col) AS rn, sum(c) OVER (PARTITION BY col) AS cn FROM g),
ks AS (SELECT col, CAST(max(rn) AS BIGINT) AS n_ref, CAST(max(cn) AS BIGINT) AS n_cur,
  max(abs(CAST(rr AS DOUBLE) / rn - CAST(cc AS DOUBLE) / cn)) AS ks FROM w GROUP BY 1),
lam AS (SELECT *, ks * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS lam FROM ks),
p AS (SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1,
  2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * lam * lam))))) END AS p_value FROM lam)"""


def _tests(spark: SparkSession, sf: str, stretch: float) -> DataFrame:
    reference, current = drift_pair(spark, sf, stretch)
    out = drift.ks_test(reference, current, DRIFT_COLUMNS, exact_rows=0)
    return out.withColumns({"ks": F.round("ks", 9), "p_value": F.round("p_value", 6), "drifted": F.col("drifted").cast("int")})


def ks_same(spark: SparkSession, sf: str) -> DataFrame:
    return _tests(spark, sf, 1.0)


def ks_moved(spark: SparkSession, sf: str) -> DataFrame:
    return _tests(spark, sf, 1.3)


_KS_SELECT = """SELECT col AS "column", n_ref, n_cur, round(ks, 9) AS ks, round(p_value, 6) AS p_value,
  CAST(p_value < 0.05 AS INT) AS drifted FROM p"""


def ks_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Line-item prices and quantities shipped before mid-1998 against those after."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_shipdate", "l_quantity", "l_extendedprice")
    cut = F.lit("1998-05-24").cast("timestamp_ntz")
    out = drift.ks_test(
        lines.filter(F.col("l_shipdate") < cut), lines.filter(F.col("l_shipdate") >= cut), ["l_quantity", "l_extendedprice"], exact_rows=0
    )
    return out.select("column", "n_ref", "n_cur", F.round("ks", 9).alias("ks"), F.round("p_value", 6).alias("p_value"))


_KS_LINES = """WITH long AS (
  SELECT 'l_quantity' AS col, CAST(l_quantity AS DOUBLE) AS v, CAST(l_shipdate >= DATE '1998-05-24' AS INT) AS cur FROM lineitem
  UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE), CAST(l_shipdate >= DATE '1998-05-24' AS INT) FROM lineitem),
g AS (SELECT col, v, count(*) FILTER (cur = 0) AS r, count(*) FILTER (cur = 1) AS c FROM long GROUP BY 1, 2),
w AS (SELECT col, sum(r) OVER (PARTITION BY col ORDER BY v) AS rr, sum(c) OVER (PARTITION BY col ORDER BY v) AS cc,
  sum(r) OVER (PARTITION BY col) AS rn, sum(c) OVER (PARTITION BY col) AS cn FROM g),
ks AS (SELECT col, CAST(max(rn) AS BIGINT) AS n_ref, CAST(max(cn) AS BIGINT) AS n_cur,
  max(abs(CAST(rr AS DOUBLE) / rn - CAST(cc AS DOUBLE) / cn)) AS ks FROM w GROUP BY 1),
lam AS (SELECT *, ks * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS lam FROM ks)
SELECT col AS "column", n_ref, n_cur, round(ks, 9) AS ks, round(CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1,
  2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * lam * lam))))) END, 6) AS p_value FROM lam"""

def user_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's amounts of the first half of the month against those of the second, with exact p-values."""
    rows = read_transactions(spark, sf).select("user_id", "amount", "ts")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    out = drift.ks_by_key(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut), "user_id", "amount", min_sample=3)
    return out.select("user_id", "n_ref", "n_cur", F.round("ks", 9).alias("ks"), F.round("p_value", 6).alias("p_value"))


# Paths through the lattice of both samples, counted step by step.
_USER_DRIFT = "WITH RECURSIVE " + TXN + f""", g AS (
  SELECT user_id, amount, count(*) FILTER (ts < TIMESTAMP '{SPLIT}') AS r, count(*) FILTER (ts >= TIMESTAMP '{SPLIT}') AS c FROM txn GROUP BY 1, 2
), w AS (SELECT user_id, sum(r) OVER u AS rr, sum(c) OVER u AS cc, sum(r) OVER (PARTITION BY user_id) AS rn, sum(c) OVER (PARTITION BY user_id) AS cn
  FROM g WINDOW u AS (PARTITION BY user_id ORDER BY amount)
), ks AS (SELECT user_id, CAST(max(rn) AS BIGINT) AS n1, CAST(max(cn) AS BIGINT) AS n2, CAST(max(abs(rr * cn - cc * rn)) AS BIGINT) AS h
  FROM w GROUP BY 1 HAVING max(rn) >= 3 AND max(cn) >= 3
), walk AS (
  SELECT user_id, n1, n2, h, CAST(0 AS BIGINT) AS i, list_transform(range(0, n2 + 1), lambda j: CAST(CASE WHEN j * n1 < h THEN 1 ELSE 0 END AS DOUBLE)) AS ways FROM ks
  UNION ALL
  SELECT user_id, n1, n2, h, i + 1, list_transform(range(0, n2 + 1), lambda j: CASE WHEN abs((i + 1) * n2 - j * n1) < h THEN
    list_sum(list_transform(range(0, j + 1), lambda x: CASE WHEN abs((i + 1) * n2 - x * n1) < h THEN ways[x + 1] ELSE 0 END)) ELSE 0 END) FROM walk WHERE i < n1
)
SELECT user_id, n1 AS n_ref, n2 AS n_cur, round(CAST(h AS DOUBLE) / (n1 * n2), 9) AS ks,
  round(CASE WHEN h = 0 THEN 1 ELSE greatest(0, 1 - ways[n2 + 1] / exp(lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1))) END, 6) AS p_value
FROM walk WHERE i = n1"""

CHI_COLUMNS = ["merchant_category", "payment_method", "country"]


def chi_square_tests(spark: SparkSession, sf: str) -> DataFrame:
    reference, current = drift_pair(spark, sf)
    out = drift.chi_square_p(drift.chi_square(reference, current, CHI_COLUMNS))
    return out.select("column", F.round("chi2", 6).alias("chi2"), "dof")


def chi_square_tail(spark: SparkSession, sf: str) -> DataFrame:
    """p-values of the tests with two degrees of freedom or more; the tail of two is exp(-x/2)."""
    reference, current = drift_pair(spark, sf)
    out = drift.chi_square_p(drift.chi_square(reference, current, ["device_type", "channel"]))
    return out.select("column", F.round("p_value", 6).alias("p_value"))


def _chi_sql(columns: list[str]) -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col, {c} AS v, CAST(ts >= TIMESTAMP '{SPLIT}' AS INT) AS cur FROM txn" for c in columns
    )
    return TXN + f""", long AS ({long}),
g AS (SELECT col, v, count(*) FILTER (cur = 0) AS o0, count(*) FILTER (cur = 1) AS o1 FROM long GROUP BY 1, 2),
t AS (SELECT *, CAST(sum(o0) OVER (PARTITION BY col) AS DOUBLE) AS r, CAST(sum(o1) OVER (PARTITION BY col) AS DOUBLE) AS c FROM g),
e AS (SELECT *, (o0 + o1) * r / (r + c) AS e0, (o0 + o1) * c / (r + c) AS e1 FROM t),
x AS (SELECT col, sum((o0 - e0) * (o0 - e0) / e0 + (o1 - e1) * (o1 - e1) / e1) AS chi2, count(*) - 1 AS dof FROM e GROUP BY 1)"""


def share_verdict(spark: SparkSession, sf: str) -> DataFrame:
    reference, current = drift_pair(spark, sf, 1.3)
    out = drift.dataset_drift(drift.ks_test(reference, current, DRIFT_COLUMNS))
    return out.select("n_tested", "n_drifted", F.array_join("drifted_features", ",").alias("features"), F.col("dataset_drift").cast("int").alias("dataset_drift"))


def any_verdict(spark: SparkSession, sf: str) -> DataFrame:
    reference, current = drift_pair(spark, sf)
    out = drift.dataset_drift(drift.ks_test(reference, current, DRIFT_COLUMNS), rule="any")
    return out.select("n_tested", "n_drifted", F.col("dataset_drift").cast("int").alias("dataset_drift"))


def shift(spark: SparkSession, sf: str) -> DataFrame:
    reference, current = drift_pair(spark, sf)
    return drift.score_shift(reference, current).select(F.round("score_shift", 6).alias("score_shift"))


def _gappy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    reference, current = drift_pair(spark, sf)
    hole = lambda df: df.select(
        "transaction_id",
        F.when(F.col("merchant_category") != "error", F.col("amount")).alias("amount"),
        F.when(F.col("country") != "CN", F.col("country")).alias("country"),
        "is_fraud",
    )
    return hole(reference), hole(current)


_GAPPY = TXN + f""", gappy AS (SELECT CASE WHEN merchant_category <> 'error' THEN amount END AS amount,
  CASE WHEN country <> 'CN' THEN country END AS country, CAST(ts >= TIMESTAMP '{SPLIT}' AS INT) AS cur FROM txn)"""


def missing(spark: SparkSession, sf: str) -> DataFrame:
    return drift.missing_ratio(_gappy(spark, sf)[1])


def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    return drift.missing_by_column(*_gappy(spark, sf))


def reference_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """First run stores the batch as the reference; the next run finds it."""
    path = scratch(spark, "reference")
    reference, current = drift_pair(spark, sf)
    before = drift.load_reference(spark, path)
    drift.set_reference(reference, path)
    stored = drift.load_reference(spark, path)
    out = drift.drift_summary(stored, current, DRIFT_COLUMNS)
    return out.select(
        F.lit(int(before is None)).alias("was_empty"), "batch_size", F.col("drift_detected").cast("int").alias("drift_detected"),
        F.round("score_shift", 6).alias("score_shift"), "missing_ratio",
    )


def report(spark: SparkSession, sf: str) -> DataFrame:
    """The run summary written as JSON and read back."""
    path = scratch(spark, "report")
    reference, current = drift_pair(spark, sf, 1.3)
    sinks.write_report(drift.drift_summary(reference, current, DRIFT_COLUMNS), path)
    schema = ("batch_size bigint, drift_detected boolean, dataset_drift boolean, n_tested bigint, n_drifted bigint, "
              "drifted_features array<string>, score_shift double, missing_ratio double")
    back = spark.read.schema(schema).json(path)
    return back.select(
        "batch_size", F.col("drift_detected").cast("int").alias("drift_detected"), "n_tested", "n_drifted",
        F.round("score_shift", 6).alias("score_shift"), "missing_ratio",
    )


def shared_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over the numeric columns both batches have."""
    reference, current = drift_pair(spark, sf)
    kept = drift.shared_numeric(current, reference.drop("merchant_id"))
    sums = current.agg(*[F.round(F.sum(F.col(c).cast("double")), 4).alias(c) for c in kept])
    return sums.unpivot([], kept, "column", "total")


# -- rules ----------------------------------------------------------------------------------------

DAY = 24 * rules.HOUR


def rule_ids(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", "user_id", "amount")


def velocity_rule(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.amount_velocity(read_transactions(spark, sf), 5, 300.0, DAY)
    return out.select("transaction_id", "window_count", F.round("window_total", 4).alias("window_total"))


def night_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rule_ids(rules.night_amount(read_transactions(spark, sf), 150.0))


def border_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rules.cross_border(read_transactions(spark, sf)).select("transaction_id", "countries")


def device_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rule_ids(rules.new_device_high_value(read_transactions(spark, sf)))


def round_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rule_ids(rules.round_run(read_transactions(spark, sf), cents=10))


def category_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rule_ids(rules.category_mismatch(read_transactions(spark, sf), ["signup", "error"]))


def address_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rules.multi_ip_sessions(read_transactions(spark, sf), 3, 6 * rules.HOUR)


def spike_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rule_ids(rules.utilization_spike(read_transactions(spark, sf)))


def decline_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rules.declines_then_approval(read_transactions(spark, sf), 3, DAY).select("transaction_id", "declines")


def uplift_rule(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.prior_fraud_uplift(scored(spark, sf), F.col("fraud_score"))
    return out.select(
        "transaction_id", F.col("prior_fraud").cast("int").alias("prior_fraud"), F.round("uplifted_score", 6).alias("uplifted_score")
    )


def routing(spark: SparkSession, sf: str) -> DataFrame:
    return rules.route(scored(spark, sf)).select("transaction_id", "fraud_score", "action", "review_due")


def filing_rule(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.loss_filings(read_transactions(spark, sf), 500.0)
    return out.select("user_id", F.round("fraud_losses", 4).alias("fraud_losses"), "last_fraud", F.col("filing_due").cast("string").alias("filing_due"))


_BACK = "PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {} PRECEDING AND {}"
_CUR, _OPEN = "CURRENT ROW", "INTERVAL 1 MICROSECOND PRECEDING"

QUERIES = {
    "a09_f08_f11_json_report": (
        report,
        with_sql(_pair_sql(1.3), f""", s AS (SELECT count(*) FILTER (ts >= TIMESTAMP '{SPLIT}') AS batch_size,
  avg(fraud_score) FILTER (ts >= TIMESTAMP '{SPLIT}') - avg(fraud_score) FILTER (ts < TIMESTAMP '{SPLIT}') AS shift FROM scored),
v AS (SELECT count(*) AS n_tested, count(*) FILTER (p_value < 0.05) AS n_drifted FROM p)
SELECT batch_size, CAST(CAST(n_drifted AS DOUBLE) / n_tested >= 0.15 OR abs(shift) > 0.05 AS INT) AS drift_detected, n_tested, n_drifted,
  round(shift, 6) AS score_shift, CAST(0 AS DOUBLE) AS missing_ratio FROM s CROSS JOIN v"""),
    ),
    "f01_reference_round_trip": (
        reference_round_trip,
        with_sql(_pair_sql(), f""", s AS (SELECT count(*) FILTER (ts >= TIMESTAMP '{SPLIT}') AS batch_size,
  avg(fraud_score) FILTER (ts >= TIMESTAMP '{SPLIT}') - avg(fraud_score) FILTER (ts < TIMESTAMP '{SPLIT}') AS shift FROM scored),
v AS (SELECT count(*) AS n_tested, count(*) FILTER (p_value < 0.05) AS n_drifted FROM p)
SELECT CAST(1 AS INT) AS was_empty, batch_size, CAST(CAST(n_drifted AS DOUBLE) / n_tested >= 0.15 OR abs(shift) > 0.05 AS INT) AS drift_detected,
  round(shift, 6) AS score_shift, CAST(0 AS DOUBLE) AS missing_ratio FROM s CROSS JOIN v"""),
    ),
    "f02_ks_same": (ks_same, with_sql(_pair_sql(), _KS_SELECT)),
    "f03_ks_moved": (ks_moved, with_sql(_pair_sql(1.3), _KS_SELECT)),
    "f03_user_drift": (user_drift, _USER_DRIFT),
    "f02_ks_lines": (ks_orders, _KS_LINES),
    "f04_chi_square": (chi_square_tests, with_sql(_chi_sql(CHI_COLUMNS), 'SELECT col AS "column", round(chi2, 6) AS chi2, dof FROM x')),
    "f04_chi_square_tail": (chi_square_tail, with_sql(_chi_sql(["device_type", "channel"]), 'SELECT col AS "column", round(exp(-chi2 / 2), 6) AS p_value FROM x')),
    "f05_share_verdict": (
        share_verdict,
        with_sql(_pair_sql(1.3), """SELECT count(*) AS n_tested, count(*) FILTER (p_value < 0.05) AS n_drifted,
  coalesce(string_agg(col, ',' ORDER BY col) FILTER (p_value < 0.05), '') AS features,
  CAST(CAST(count(*) FILTER (p_value < 0.05) AS DOUBLE) / count(*) >= 0.15 AS INT) AS dataset_drift FROM p"""),
    ),
    "f06_any_verdict": (
        any_verdict,
        with_sql(_pair_sql(), """SELECT count(*) AS n_tested, count(*) FILTER (p_value < 0.05) AS n_drifted,
  CAST(count(*) FILTER (p_value < 0.05) > 0 AS INT) AS dataset_drift FROM p"""),
    ),
    "f07_score_shift": (
        shift,
        with_sql(SCORED, f"SELECT round(avg(fraud_score) FILTER (ts >= TIMESTAMP '{SPLIT}') - avg(fraud_score) FILTER (ts < TIMESTAMP '{SPLIT}'), 6) AS score_shift FROM scored"),
    ),
    "f09_missing_ratio": (
        missing,
        with_sql(_GAPPY, "SELECT round(CAST((count(*) FILTER (amount IS NULL) + count(*) FILTER (country IS NULL)) AS DOUBLE) / (count(*) * 4), 4) AS missing_ratio FROM gappy WHERE cur = 1"),
    ),
    "f10_missing_by_column": (
        missing_columns,
        with_sql(_GAPPY, "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER (cur = 0 AND {cond}) AS missing_ref, count(*) FILTER (cur = 1 AND {cond}) AS missing_cur FROM gappy"""
            for c, cond in [("transaction_id", "false"), ("amount", "amount IS NULL"), ("country", "country IS NULL"), ("is_fraud", "false")])),
    ),
    "e09_shared_columns": (
        shared_columns,
        with_sql(SCORED, "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", round(sum(CAST({c} AS DOUBLE)), 4) AS total FROM scored WHERE ts >= TIMESTAMP '{SPLIT}'"""
            for c in ("user_id", "amount", "account_age_days", "credit_utilization", "prior_fraud_count", "is_fraud", "fraud_score", "anomaly_score"))),
    ),
    "i01_amount_velocity": (
        velocity_rule,
        with_sql(TXN, f""", w AS (SELECT transaction_id, count(*) OVER ({_BACK.format('1 DAY', _CUR)}) AS window_count,
  round(sum(amount) OVER ({_BACK.format('1 DAY', _CUR)}), 4) AS window_total FROM txn)
SELECT * FROM w WHERE window_count > 5 AND window_total > 300"""),
    ),
    "i02_night_amount": (night_rule, with_sql(TXN, "SELECT transaction_id, user_id, amount FROM txn WHERE amount > 150 AND hour(ts) >= 1 AND hour(ts) < 5")),
    "i03_cross_border": (
        border_rule,
        with_sql(TXN, """SELECT a.transaction_id, count(DISTINCT b.country) AS countries FROM txn a JOIN txn b
  ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts GROUP BY 1 HAVING count(DISTINCT b.country) >= 2"""),
    ),
    "i04_new_device": (
        device_rule,
        with_sql(TXN, """, q AS (SELECT user_id, quantile_cont(amount, 0.95) AS mark FROM txn GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, device_fingerprint ORDER BY ts, transaction_id) AS rn FROM txn)
SELECT transaction_id, user_id, amount FROM f JOIN q USING (user_id) WHERE rn = 1 AND amount > mark"""),
    ),
    "i05_round_run": (
        round_rule,
        with_sql(TXN, """, l AS (SELECT *, CAST(round(amount * 100) AS BIGINT) % 10 = 0 AS r0,
  lag(CAST(round(amount * 100) AS BIGINT) % 10 = 0, 1) OVER w AS r1, lag(CAST(round(amount * 100) AS BIGINT) % 10 = 0, 2) OVER w AS r2,
  lag(ts, 2) OVER w AS t2 FROM txn WINDOW w AS (PARTITION BY user_id ORDER BY ts, transaction_id))
SELECT transaction_id, user_id, amount FROM l WHERE r0 AND r1 AND r2 AND ts - t2 <= INTERVAL 24 HOUR"""),
    ),
    "i06_category_mismatch": (
        category_rule,
        with_sql(TXN, """SELECT transaction_id, user_id, amount FROM txn WHERE merchant_category IN ('signup', 'error')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, transaction_id) = 1"""),
    ),
    "i07_session_addresses": (
        address_rule,
        with_sql(TXN, """, o AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS INT) AS opens FROM txn),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(DISTINCT ip_address) AS ips, count(*) AS transactions
FROM s GROUP BY user_id, session HAVING count(DISTINCT ip_address) > 3"""),
    ),
    "i08_utilization_spike": (
        spike_rule,
        with_sql(TXN, f""", w AS (SELECT *, min(credit_utilization) OVER ({_BACK.format('48 HOUR', _OPEN)}) AS low FROM txn)
SELECT transaction_id, user_id, amount FROM w WHERE credit_utilization > 0.9 AND low < 0.4"""),
    ),
    "i09_declines_then_approval": (
        decline_rule,
        with_sql(TXN, f""", w AS (SELECT *, count(*) FILTER (status = 'declined') OVER ({_BACK.format('1 DAY', _OPEN)}) AS declines FROM txn)
SELECT transaction_id, declines FROM w WHERE status = 'approved' AND declines > 3"""),
    ),
    "i10_prior_fraud_uplift": (
        uplift_rule,
        with_sql(SCORED, f""", w AS (SELECT *, coalesce(max(is_fraud) OVER ({_BACK.format('365 DAY', _OPEN)}), 0) AS seen FROM scored)
SELECT transaction_id, CAST(seen AS INT) AS prior_fraud, round(CASE WHEN seen = 1 THEN least(1, fraud_score + CAST(0.2 AS DOUBLE)) ELSE fraud_score END, 6) AS uplifted_score FROM w"""),
    ),
    "i11_routing": (
        routing,
        with_sql(SCORED, """SELECT transaction_id, fraud_score, CASE WHEN fraud_score >= 0.9 THEN 'BLOCK' WHEN fraud_score >= 0.7 THEN 'MFA'
  WHEN fraud_score >= 0.5 THEN 'REVIEW' ELSE 'ALLOW' END AS action,
  CASE WHEN fraud_score >= 0.5 AND fraud_score < 0.7 THEN ts + INTERVAL 4 HOUR END AS review_due FROM scored"""),
    ),
    "i12_loss_filings": (
        filing_rule,
        with_sql(TXN, """SELECT user_id, round(sum(amount), 4) AS fraud_losses, max(ts) AS last_fraud,
  strftime(CAST(max(ts) AS DATE) + 30, '%Y-%m-%d') AS filing_due FROM txn WHERE is_fraud = 1 GROUP BY 1 HAVING sum(amount) > 500"""),
    ),
}
