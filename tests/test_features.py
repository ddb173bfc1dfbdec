import pytest
from pyspark.sql import functions as F

from riskloom.operators.features import FeatureBuilder, FeatureModel
from riskloom.schema import FEATURE_COLUMNS


def by_id(df, *cols):
    return {r["transaction_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_fit_learns_state(sample):
    model = FeatureBuilder().fit(sample)
    freq = {(r["column"], r["value"]): r["freq"] for r in model.frequencies.collect()}
    assert freq[("merchant_category", "retail")] == pytest.approx(0.4)
    assert model.stats["amount"]["mean"] == pytest.approx(1085.0)
    assert model.stats["amount"]["p95"] == pytest.approx(200 + 0.8 * 4800)


def test_transform_before_fit_raises(sample):
    with pytest.raises(RuntimeError, match="Call fit"):
        FeatureBuilder().transform(sample)


def test_contract_columns_and_input_untouched(sample):
    before = list(sample.columns)
    out = FeatureBuilder().fit_transform(sample)
    missing = set(FEATURE_COLUMNS) - set(out.columns)
    assert missing == {"unique_ips", "multi_country_session", "unique_devices", "new_device"}
    assert sample.columns == before


def test_fit_transform_is_fit_then_transform(sample):
    a = FeatureBuilder().fit_transform(sample)
    b = FeatureBuilder().fit(sample).transform(sample)
    assert a.exceptAll(b.select(*a.columns)).count() == 0


def test_velocity_excludes_the_row_itself(sample):
    out = by_id(FeatureBuilder().fit_transform(sample), "txn_count_1d", "txn_total_1d")
    assert out == {"a": (0, 0.0), "b": (1, 100.0), "c": (0, 0.0), "d": (1, 50.0), "e": (0, 0.0)}


def test_zero_amount(sample):
    out = FeatureBuilder().fit(sample).transform(sample.withColumn("amount", F.lit(0.0)))
    assert {r["amount_log"] for r in out.collect()} == {0.0}


def test_without_time_no_calendar_or_velocity(sample):
    out = FeatureBuilder().fit_transform(sample.drop("ts"))
    assert not {"hour_of_day", "txn_count_1d"} & set(out.columns)
    assert "amount_vs_user_median" in out.columns


def test_unseen_and_null_categories(sample):
    model = FeatureBuilder().fit(sample)
    odd = sample.withColumn("merchant_category", F.when(F.col("user_id") == 1, F.lit("never seen")))
    assert {r["merchant_category_freq"] for r in model.transform(odd).collect()} == {0.0}


def test_single_row(sample):
    assert FeatureBuilder().fit(sample).transform(sample.limit(1)).count() == 1


def test_history_counts_for_a_single_row(sample):
    model = FeatureBuilder().fit(sample)
    new, old = sample.filter("transaction_id = 'b'"), sample.filter("transaction_id = 'a'")
    assert by_id(model.transform(new), "txn_count_1d") == {"b": (0,)}
    assert by_id(model.transform(new, old), "txn_count_1d", "txn_total_1d") == {"b": (1, 100.0)}


def test_missing_user_time_and_amount(spark):
    rows = [
        ("a", 1, 10.0, "2024-01-06 17:59:59"),
        ("b", 1, None, "2024-01-06 22:00:00"),
        ("c", None, 30.0, "2024-01-05 17:59:00"),
        ("d", 1, float("nan"), None),
        ("e", None, 5.0, None),
    ]
    df = spark.createDataFrame(rows, "transaction_id string, user_id bigint, amount double, t string")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    out = FeatureBuilder().fit_transform(df)
    assert out.count() == 5
    got = by_id(out, "txn_count_1d", "txn_total_1d", "amount_above_p95", "is_night", "is_weekend", "is_business_hours")
    assert got["a"] == (0, 0.0, 0, 0, 1, 0)
    assert got["b"] == (1, 10.0, 0, 1, 1, 0)
    assert got["c"] == (0, 0.0, 1, 0, 0, 1)
    assert got["d"][:3] == (0, 0.0, 0) and got["d"][3:] == (0, 0, 0)
    ratio = by_id(out, "amount_vs_user_median")
    assert ratio["a"][0] == pytest.approx(1.0) and ratio["c"] == (None,) and ratio["d"] == (None,)


def test_state_round_trip(spark, sample, tmp_path):
    model = FeatureBuilder(velocity_windows=[2]).fit(sample)
    loaded = FeatureModel.load(spark, model.save(str(tmp_path / "state")))
    a, b = model.transform(sample), loaded.transform(sample)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0


def test_large_frequency_table_is_not_broadcast(sample):
    model = FeatureBuilder().fit(sample)
    model.small_frequencies = []
    a, b = model.transform(sample), FeatureBuilder().fit_transform(sample)
    assert a.exceptAll(b.select(*a.columns)).count() == 0
