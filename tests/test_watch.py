import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift
from riskloom.operators.metrics import average_precision, roc_auc, score_histogram
from riskloom.plans.monitoring import DriftMonitor
from riskloom.sources.sinks import read_kpis


def column(spark, values, name="v"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_ks_statistic(spark):
    rng = random.Random(2)
    a, b = [round(rng.gauss(0, 1), 1) for _ in range(90)], [round(rng.gauss(0.6, 1), 1) for _ in range(70)]
    r = drift.ks_test(column(spark, [*a, None, float("nan")]), column(spark, b), exact_rows=0).first()
    want = max(abs(sum(x <= t for x in a) / 90 - sum(x <= t for x in b) / 70) for t in {*a, *b})
    assert (r["n_ref"], r["n_cur"]) == (90, 70) and r["ks"] == pytest.approx(want)
    lam = want * math.sqrt(90 * 70 / 160)
    assert r["p_value"] == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)))


def test_ks_needs_ten_values(spark):
    assert drift.ks_test(column(spark, range(9)), column(spark, range(50))).count() == 0


def test_ks_p_value_points(spark):
    df = spark.createDataFrame([(1.358,), (0.2,), (0.1,), (0.0,)], "lam double")
    p = [r[0] for r in df.select(drift.kolmogorov_p(F.col("lam"), F.lit(2), F.lit(2))).collect()]
    assert p[0] == pytest.approx(0.05, abs=1e-3) and p[1:] == pytest.approx([1.0, 1.0, 1.0])


@pytest.mark.parametrize("chi2, dof, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (200.0, 4, 0.0)])
def test_chi_square_tail(spark, chi2, dof, p):
    df = spark.createDataFrame([(chi2, dof)], "chi2 double, dof bigint")
    assert drift.chi_square_p(df).first()["p_value"] == pytest.approx(p, abs=1e-9)


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (0, 0.2)], "y int, s double")
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx((3.5 + 2.5) / 8)
    # Steps at 0.9 (tp 1 of 2) and 0.5 (tp 2 of 4), each adding half the recall.
    assert average_precision(df, "y", "s").first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 0.5)
    assert roc_auc(df.filter("y = 0"), "y", "s").first()[0] is None


def test_histogram_is_cumulative(spark):
    rows = {r["le"]: r["n"] for r in score_histogram(column(spark, [0.0, 0.05, 0.1, 1.0], "fraud_score")).collect()}
    assert (rows["0.0"], rows["0.1"], rows["0.9"], rows["1.0"], rows["+Inf"]) == (1, 3, 3, 4, 4)


def test_missing_ratio(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (None, "y")], "a double, b string")
    assert drift.missing_ratio(df).first()[0] == 0.5
    assert drift.missing_ratio(df.limit(0)).first()[0] == 0.0


def test_score_shift_without_scores(spark):
    df = column(spark, [1.0])
    assert drift.score_shift(df, df).first()[0] == 0.0


def test_monitor_runs(spark, tmp_path):
    monitor = DriftMonitor(str(tmp_path))
    rng = random.Random(4)
    base = spark.createDataFrame([(f"t{i}", rng.random(), rng.random()) for i in range(300)], "transaction_id string, amount double, fraud_score double")
    assert monitor.run(base).first()["reason"] == "first run: kept as the reference"
    same = monitor.run(base, run_name="r1").first()
    assert not same["drift_detected"] and same["n_tested"] == 2 and same["batch_size"] == 300
    moved = monitor.run(base.withColumn("fraud_score", F.col("fraud_score") + 0.3), run_name="r2").first()
    assert moved["drift_detected"] and moved["drifted_features"] == ["fraud_score"] and moved["score_shift"] == pytest.approx(0.3)
    log = {r["run_timestamp"]: r for r in read_kpis(spark, f"{tmp_path}/kpis").collect()}
    assert (log["r1"]["drift_detected"], log["r2"]["drift_detected"], log["r2"]["n_drifted_features"]) == (0, 1, 1)


def test_rules_differ(spark):
    tests = spark.createDataFrame([("a", True)] + [(f"b{i}", False) for i in range(9)], "column string, drifted boolean")
    assert not drift.dataset_drift(tests).first()["dataset_drift"]
    assert drift.dataset_drift(tests, rule="any").first()["dataset_drift"]
    assert not drift.dataset_drift(tests.limit(0)).first()["dataset_drift"]


@pytest.mark.parametrize("seed", range(6))
def test_exact_p_value_by_enumeration(seed):
    """All orders of two small samples, counted."""
    rng = np.random.default_rng(seed)
    m, n = (int(x) for x in rng.integers(1, 8, 2))

    def distance(places):
        at = np.isin(np.arange(m + n), places)
        return int(np.abs(np.cumsum(at) * n - np.cumsum(~at) * m).max())

    every = [distance(p) for p in combinations(range(m + n), m)]
    for d in sorted(set(every)):
        assert drift.exact_p(d / (m * n), m, n) == pytest.approx(np.mean([e >= d for e in every]), abs=1e-12)


def test_exact_and_asymptotic_p_values_meet(spark):
    a, b = [float(i) for i in range(400)], [float(i) + 31.5 for i in range(400)]
    exact = drift.ks_test(column(spark, a), column(spark, b)).first()["p_value"]
    rough = drift.ks_test(column(spark, a), column(spark, b), exact_rows=0).first()["p_value"]
    assert exact != rough and abs(exact - rough) < 0.02
    assert drift.exact_p(0.0, 5, 5) == 1.0 and drift.exact_p(1.0, 2000, 2000) == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 300 + [7.0], None])
def test_bracketed_quantiles(spark, values):
    from riskloom.functions.ordering import column_quantiles

    rng = np.random.default_rng(1)
    data = values or np.round(rng.exponential(3.0, 30_000), 3).tolist()
    rows = spark.createDataFrame([(float(v), None, i % 7) for i, v in enumerate(data)], "a double, b double, c int")
    got = {r["column"]: r for r in column_quantiles(rows, ["a", "b", "c"], {"p50": 0.5, "p95": 0.95, "p100": 1.0}, accuracy=100).collect()}
    assert set(got) == {"a", "c"}
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
        assert got["a"][name] == pytest.approx(np.quantile(data, q), abs=1e-12)
