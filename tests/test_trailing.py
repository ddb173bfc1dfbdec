"""Trailing windows, quantiles and running totals against brute force, light and heavy keys alike."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskloom.functions.ordering import ordered_totals, user_quantiles
from riskloom.operators.trailing import Trailing, with_trailing

HOUR = 3_600_000_000


def rows(seed, n=160):
    """A third of all rows in one user, many ties, some missing users and times."""
    rng = random.Random(seed)
    start = dt.datetime(2024, 3, 9, 22)
    out = []
    for i in range(n):
        user = 1 if rng.random() < 0.34 else rng.choice([2, 3, 4, None])
        ts = None if rng.random() < 0.05 else start + dt.timedelta(minutes=10 * rng.randrange(60), microseconds=rng.choice([0, 0, 1]))
        out.append((i, user, ts, round(rng.uniform(0, 90), 2), rng.random() < 0.2))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id bigint, user_id bigint, ts timestamp_ntz, amount double, bad boolean")


@pytest.mark.parametrize("heavy_limit", [10_000, 5])
@pytest.mark.parametrize("closed", ["left", "both"])
def test_matches_brute_force(spark, heavy_limit, closed):
    data = rows(heavy_limit + len(closed))
    measures = [
        Trailing("n1", "count", HOUR, F.lit(True), closed),
        Trailing("n3", "count", 3 * HOUR, F.col("bad"), closed),
        Trailing("s2", "sum", 2 * HOUR, F.col("amount"), closed),
        Trailing("seen", "seen", 2 * HOUR, F.col("bad"), closed),
    ]
    got = {r["id"]: r for r in with_trailing(frame(spark, data), measures, heavy_limit=heavy_limit).collect()}
    assert len(got) == len(data)

    def window(user, ts, hours):
        if user is None or ts is None:
            return []
        span = dt.timedelta(hours=hours)
        return [r for r in data if r[1] == user and r[2] is not None and ts - span <= r[2] and (r[2] < ts or (closed == "both" and r[2] == ts))]

    for i, user, ts, _, _ in data:
        r = got[i]
        assert r["n1"] == len(window(user, ts, 1))
        assert r["n3"] == sum(x[4] for x in window(user, ts, 3))
        assert r["s2"] == pytest.approx(sum(x[3] for x in window(user, ts, 2)), abs=1e-6)
        assert r["seen"] == any(x[4] for x in window(user, ts, 2))


def test_exact_edge_counts(spark):
    at = dt.datetime(2024, 1, 8)
    df = frame(spark, [(0, 1, at - dt.timedelta(days=7), 1.0, False), (1, 1, at - dt.timedelta(days=7, microseconds=1), 1.0, False), (2, 1, at, 1.0, False)])
    got = {r["id"]: r["n"] for r in with_trailing(df, [Trailing("n", "count", 7 * 24 * HOUR, F.lit(True))]).collect()}
    assert got[2] == 1


@pytest.mark.parametrize("heavy_limit", [10_000, 5])
def test_user_quantiles(spark, heavy_limit):
    data = rows(7)
    out = user_quantiles(frame(spark, data), "user_id", "amount", {"m": 0.5, "hi": 0.95}, heavy_limit).collect()
    assert {r["user_id"] for r in out} == {1, 2, 3, 4}
    for r in out:
        values = sorted(x[3] for x in data if x[1] == r["user_id"])
        place = 0.95 * (len(values) - 1)
        low = int(place)
        high = min(low + 1, len(values) - 1)
        assert r["m"] == pytest.approx(statistics.median(values))
        assert r["hi"] == pytest.approx(values[low] + (values[high] - values[low]) * (place - low))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ordered_totals(spark, descending, partitions):
    rng = random.Random(partitions)
    data = {(k, v): rng.randrange(9) for k in ("a", "b", None) for v in rng.sample(range(300), 60)}
    df = spark.createDataFrame([(k, v, n) for (k, v), n in data.items()], "k string, v int, n int")
    out = ordered_totals(df, ["k"], ["v"], {"upto": "n"}, descending, partitions, with_totals=True).collect()
    assert len(out) == len(data)
    for r in out:
        same = {v: n for (k, v), n in data.items() if k == r["k"]}
        assert r["upto"] == sum(n for v, n in same.items() if (v >= r["v"] if descending else v <= r["v"]))
        assert r["upto_all"] == sum(same.values())
    plain = ordered_totals(df, ["k"], ["v"], {"upto": "n"}, descending, partitions)
    both = {(r["k"], r["v"]): r["upto"] for r in plain.collect()}
    assert both == {(r["k"], r["v"]): r["upto"] for r in out}


@pytest.mark.parametrize("heavy_limit", [10_000, 2])
def test_huge_and_infinite_amounts(spark, heavy_limit):
    """Sums stay exact beside 1e15; what no decimal holds adds nothing and stops no job."""
    start = dt.datetime(2024, 5, 1)
    amounts = [1e15, 0.000001, float("inf"), float("nan"), 2.5, -1e15]
    data = [(i, 1, start + dt.timedelta(minutes=i), a, False) for i, a in enumerate(amounts)]
    out = with_trailing(frame(spark, data), [Trailing("s", "sum", 24 * HOUR, F.col("amount"), "both")], heavy_limit=heavy_limit)
    got = [r["s"] for r in out.orderBy("id").collect()]
    assert got[1:] == [float("1000000000000000.000001")] * 3 + [float("1000000000000002.500001"), 2.500001]
