import pytest
from pyspark.sql import functions as F

from riskloom.functions.scalars import align_to_contract, parse_timestamp, risk_tier, signed
from riskloom.operators.validation import apply_defaults, from_json_lines, split, to_transactions, validate
from riskloom.plans.scoring import assign_ids
from riskloom.sources import sinks


def checked(spark, *texts):
    return validate(apply_defaults(from_json_lines(spark.createDataFrame([(t,) for t in texts], "value string"))))


@pytest.mark.parametrize(
    "text, errors",
    [
        ('{"user_id": 12345, "amount": 4999.99, "credit_utilization": 0.85}', []),
        ('{"amount": 100}', ["user_id is required."]),
        ('{"user_id": 1}', ["amount is required."]),
        ('{"user_id": 1, "amount": 0}', ["amount must be greater than 0."]),
        ('{"user_id": 1, "amount": -50}', ["amount must be greater than 0."]),
        ('{"user_id": 1, "amount": 5, "credit_utilization": 1.5}', ["credit_utilization must be 0–1."]),
        ('{"user_id": 1, "amount": 5, "account_age_days": -1}', ["account_age_days must be >= 0."]),
        ("", ["user_id is required.", "amount is required."]),
    ],
)
def test_request_errors(spark, text, errors):
    row = checked(spark, text).first()
    assert row["errors"] == errors
    assert row["status"] == ("rejected" if errors else "valid")


@pytest.mark.parametrize(
    "fields, errors",
    [
        ('"credit_utilization": "high", "account_age_days": "x"', ["account_age_days must be a whole number.", "credit_utilization must be a number."]),
        ('"credit_utilization": "0.5", "account_age_days": " 7 ", "prior_fraud_count": "1_0"', []),
        ('"account_age_days": 7.9', []),
        ('"account_age_days": true', ["account_age_days must be a whole number."]),
        ('"account_age_days": 99999999999', ["account_age_days must be a whole number."]),
        ('"account_age_days": {"a": 1}', ["account_age_days must be a whole number."]),
        ('"credit_utilization": "NaN"', ["credit_utilization must be a finite number."]),
        ('"merchant_category": null', ["merchant_category may not be null."]),
        ('"transaction_id": null, "timestamp": null, "country": null', []),
        ('"merchant_category": 5, "explain": 2', ["merchant_category must be text.", "explain must be true or false."]),
        ('"explain": "yes"', []),
    ],
)
def test_wrong_types_are_told_from_absent_fields(spark, fields, errors):
    assert checked(spark, '{"user_id": 1, "amount": 5, ' + fields + "}").first()["errors"] == errors


def test_values_of_odd_spellings(spark):
    r = checked(spark, '{"user_id": "12", "amount": "1e2", "account_age_days": 7.9, "prior_fraud_count": "1_0", "explain": "on"}').first()
    assert (r["user_id"], r["amount"], r["account_age_days"], r["prior_fraud_count"], r["explain"], r["status"]) == (12, 100.0, 7, 10, True, "valid")
    r = checked(spark, '{"user_id": null, "amount": "Infinity"}').first()
    assert r["errors"] == ["user_id may not be null.", "amount must be a finite number."]


def test_columns_of_another_type(spark):
    rows = spark.createDataFrame([("1", "5", "x"), ("a", "5", None)], "user_id string, amount string, credit_utilization string")
    got = [r["errors"] for r in validate(apply_defaults(rows)).collect()]
    assert got == [["credit_utilization must be a number."], ["user_id must be a whole number."]]


def test_defaults(spark):
    r = checked(spark, '{"user_id": 1, "amount": 2}').first()
    assert (r["merchant_category"], r["channel"], r["account_age_days"], r["credit_utilization"], r["explain"]) == (
        "unknown", "online", 365, 0.3, False)


def test_one_bad_row_rejects_the_batch(spark):
    rows = checked(spark, '{"user_id": 1, "amount": 2}', '{"amount": 2}')
    assert [d.count() for d in split(rows)] == [1, 1]
    assert [d.count() for d in split(rows, reject_batch=True)] == [0, 2]


def test_requests_become_transactions(spark):
    rows = checked(spark, '{"user_id": 1, "amount": 2, "timestamp": "2024-01-15T02:30:00"}')
    out = assign_ids(to_transactions(split(rows)[0])).first()
    assert out["ts"].hour == 2 and len(out["transaction_id"]) == 36


def test_feedback(spark, tmp_path):
    path = str(tmp_path / "feedback")
    schema = "transaction_id string, predicted_tier string, actual_label int, analyst_id string"
    rows = spark.createDataFrame([("TXN-0001-AA", "HIGH", 1, "x"), (None, "HIGH", 1, None)], schema)
    assert sinks.log_feedback(rows, path).count() == 1
    sinks.log_feedback(rows.limit(1), path)
    log = sinks.read_feedback(spark, path)
    assert log.count() == 2 and log.select("request_id").distinct().count() == 2


def test_tier_bounds(spark):
    scores = [0.9, 0.7, 0.5, 0.3, 0.29, 0.95]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert [r[0] for r in df.select(risk_tier(F.col("s"))).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "CLEAN", "CRITICAL"]
    own = risk_tier(F.col("s"), {"HIGH": 0.2})
    assert {r[0] for r in df.select(own).collect()} == {"HIGH"}


def test_small_helpers(spark):
    df = spark.createDataFrame([(1.0, -0.00004), (None, 12345.67895)], "a double, b double")
    assert [tuple(r) for r in align_to_contract(df, ["z", "a"]).collect()] == [(0.0, 1.0), (0.0, 0.0)]
    assert [r[0] for r in df.select(signed(F.col("b"))).collect()] == [f"{v:+.4f}" for v in (-0.00004, 12345.67895)]
    bad = spark.createDataFrame([("nope",), ("2024-02-30T00:00:00",)], "t string")
    assert [r[0] for r in bad.select(parse_timestamp(F.col("t"))).collect()] == [None, None]


def test_slot_rewrite_keeps_other_slots(spark, sample, tmp_path):
    from riskloom.sources.transactions import read_slot, read_partitioned

    path = str(tmp_path / "slots")
    rows = sample.withColumns({c: F.lit(None).cast(t) for c, t in [("merchant_id", "bigint"), ("ip_address", "string"),
                              ("device_fingerprint", "string"), ("country", "string"), ("status", "string"), ("is_fraud", "int")]})
    sinks.write_slots(rows, path)
    sinks.write_slots(rows.filter("transaction_id = 'a'").withColumn("amount", F.lit(1.0)), path)
    assert read_partitioned(spark, path).count() == 5
    assert read_slot(spark, path, "20240101_0000").first()["amount"] == 1.0
