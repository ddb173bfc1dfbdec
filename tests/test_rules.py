"""Rules at their default thresholds, on rows written for them."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import rules

T0 = dt.datetime(2024, 5, 6, 1, 0)


def table(spark, rows):
    """rows: (id, user, minutes after T0, amount, extra columns by name)."""
    base = {"merchant_category": "retail", "country": "US", "device_fingerprint": "D1", "ip_address": "1.1.1.1",
            "credit_utilization": 0.5, "status": "approved", "is_fraud": 0}
    data = [
        (i, u, T0 + dt.timedelta(minutes=m), float(a), *[{**base, **x}[c] for c in base]) for i, u, m, a, x in rows
    ]
    return spark.createDataFrame(
        data,
        "transaction_id string, user_id bigint, ts timestamp_ntz, amount double, merchant_category string, country string, "
        "device_fingerprint string, ip_address string, credit_utilization double, status string, is_fraud int",
    )


def ids(df):
    return sorted(r["transaction_id"] for r in df.collect())


def test_amount_velocity(spark):
    df = table(spark, [(f"t{i}", 1, 10 * i, 400, {}) for i in range(8)])
    assert ids(rules.amount_velocity(df)) == ["t5", "t6", "t7"]


def test_night_amount(spark):
    df = table(spark, [("a", 1, 0, 500.01, {}), ("b", 1, 0, 500, {}), ("c", 1, 239, 900, {}), ("d", 1, 240, 900, {})])
    assert ids(rules.night_amount(df)) == ["a", "c"]


def test_cross_border_reads_rows_without_country(spark):
    df = table(spark, [("a", 1, 0, 1, {}), ("b", 1, 60, 1, {"country": "GB"}), ("c", 1, 120, 1, {"country": None}),
                       ("d", 1, 121, 1, {"country": "GB"}), ("e", 2, 60, 1, {"country": "GB"})])
    assert ids(rules.cross_border(df)) == ["b", "c"]


def test_new_device(spark):
    rows = [(f"t{i:02d}", 1, i, 10 + i, {}) for i in range(30)] + [("z", 1, 50, 900, {"device_fingerprint": "D2"})]
    assert ids(rules.new_device_high_value(table(spark, rows))) == ["z"]


def test_round_run(spark):
    df = table(spark, [("a", 1, 0, 100, {}), ("b", 1, 1, 200, {}), ("c", 1, 2, 300, {}), ("d", 1, 3, 5.5, {}), ("e", 1, 4, 7, {}),
                       ("f", 1, 5, 8, {}), ("g", 1, 5 + 24 * 60, 9, {}), ("h", 2, 5, 9, {})])
    assert ids(rules.round_run(df)) == ["c"]


def test_category_mismatch(spark):
    df = table(spark, [("a", 1, 5, 1, {"merchant_category": "crypto"}), ("b", 1, 9, 1, {"merchant_category": "gambling"}), ("c", 2, 0, 1, {})])
    assert ids(rules.category_mismatch(df)) == ["a"]


def test_multi_ip_sessions(spark):
    rows = [(f"t{i}", 1, 10 * i, 1, {"ip_address": f"1.1.1.{i}"}) for i in range(4)]
    rows += [("late", 1, 30 + 31, 1, {"ip_address": "9.9.9.9"}), ("edge", 2, 0, 1, {}), ("edge2", 2, 30, 1, {"ip_address": "2"})]
    out = rules.multi_ip_sessions(table(spark, rows)).collect()
    assert [(r["user_id"], r["ips"], r["transactions"], r["session_start"]) for r in out] == [(1, 4, 4, T0)]


def test_utilization_spike(spark):
    u = lambda x: {"credit_utilization": x}
    df = table(spark, [("a", 1, 0, 1, u(0.3)), ("b", 1, 60, 1, u(0.95)), ("c", 1, 49 * 60, 1, u(0.95)), ("d", 2, 0, 1, u(0.95))])
    assert ids(rules.utilization_spike(df)) == ["b"]


def test_declines_then_approval(spark):
    no = {"status": "declined"}
    df = table(spark, [(f"n{i}", 1, i, 1, no) for i in range(4)] + [("ok", 1, 10, 1, {}), ("late", 1, 33, 1, {})])
    assert ids(rules.declines_then_approval(df)) == ["ok"]


def test_prior_fraud_uplift(spark):
    df = table(spark, [("a", 1, 0, 1, {"is_fraud": 1}), ("b", 1, 60, 1, {}), ("c", 2, 60, 1, {})]).withColumn("s", F.lit(0.9))
    out = {r["transaction_id"]: r["uplifted_score"] for r in rules.prior_fraud_uplift(df, F.col("s")).collect()}
    assert out == {"a": 0.9, "b": 1.0, "c": 0.9}


def test_routing_bounds(spark):
    df = table(spark, [(str(s), 1, 0, 1, {}) for s in (0.9, 0.89, 0.7, 0.5, 0.49)]).withColumn("fraud_score", F.col("transaction_id").cast("double"))
    out = {r["transaction_id"]: (r["action"], r["review_due"]) for r in rules.route(df).collect()}
    assert [out[k][0] for k in ("0.9", "0.89", "0.7", "0.5", "0.49")] == ["BLOCK", "MFA", "MFA", "REVIEW", "ALLOW"]
    assert out["0.5"][1] == T0 + dt.timedelta(hours=4) and out["0.9"][1] is None


def test_loss_filings(spark):
    bad = {"is_fraud": 1}
    df = table(spark, [("a", 1, 0, 3000, bad), ("b", 1, 5, 2000.5, bad), ("c", 2, 0, 5000, bad), ("d", 1, 0, 9000, {})])
    out = rules.loss_filings(df).collect()
    assert [(r["user_id"], r["fraud_losses"], r["filing_due"]) for r in out] == [(1, 5000.5, dt.date(2024, 6, 5))]
