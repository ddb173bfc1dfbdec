import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import local_session

    session = local_session("8", shuffle_partitions=4, app="riskloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return SMALL


@pytest.fixture()
def sample(spark):
    """Five transactions of three users, an hour apart."""
    rows = [
        ("a", 1, 100.0, 365, 0.3, 0, "retail", "credit", "mobile", "online", "2024-01-01 00:00:00"),
        ("b", 1, 200.0, 365, 0.4, 0, "grocery", "debit", "desktop", "pos", "2024-01-01 01:00:00"),
        ("c", 2, 50.0, 730, 0.2, 0, "retail", "credit", "mobile", "online", "2024-01-01 02:00:00"),
        ("d", 2, 75.0, 730, 0.5, 1, "crypto", "wire", "mobile", "online", "2024-01-01 03:00:00"),
        ("e", 3, 5000.0, 12, 0.95, 2, "crypto", "wire", "mobile", "online", "2024-01-01 04:00:00"),
    ]
    schema = (
        "transaction_id string, user_id bigint, amount double, account_age_days int, credit_utilization double, "
        "prior_fraud_count int, merchant_category string, payment_method string, device_type string, channel string, t string"
    )
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
