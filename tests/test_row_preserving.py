"""Anomaly scores come back for every row, whatever its id."""

import numpy as np

from riskloom.operators.anomaly import AnomalyDetector


def test_null_and_repeated_ids_keep_their_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{i}", *map(float, rng.normal(size=3))) for i in range(60)]
    train = spark.createDataFrame(rows, "transaction_id string, a double, b double, c double")
    detector = AnomalyDetector(n_estimators=5).fit(train, ["a", "b", "c"])
    odd = [(None, *rows[0][1:]), ("x", *rows[1][1:]), ("x", *rows[2][1:]), ("y", *rows[1][1:])]
    got = detector.score(spark.createDataFrame(odd, train.schema)).collect()
    assert sorted((r["transaction_id"] or "", r["a"]) for r in got) == sorted((i or "", a) for i, a, *_ in odd)
    by = {(r["transaction_id"], r["a"]): r["anomaly_score"] for r in got}
    assert by["x", rows[1][1]] == by["y", rows[1][1]]
