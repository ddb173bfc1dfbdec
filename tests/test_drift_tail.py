"""The tail of the chi-square law against closed forms, at any size."""

import math

import pytest

from riskloom.operators.drift import chi_square_p


def even_tail(chi2, dof):
    """exp(-x) times the first dof / 2 terms of the exponential series."""
    x = chi2 / 2
    return sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(dof // 2))


def test_even_degrees(spark):
    cases = [(c, d) for d in (2, 4, 6, 50) for c in (0.1, 1.0, 5.0, 49.0, 60.0, 300.0, 1600.0, 50_000.0, 1e9, 3e9)]
    got = chi_square_p(spark.createDataFrame([(float(c), d) for c, d in cases], "chi2 double, dof bigint")).collect()
    for r in got:
        assert r["p_value"] == pytest.approx(even_tail(r["chi2"], r["dof"]), rel=1e-9, abs=1e-300)


def test_one_degree(spark):
    got = chi_square_p(spark.createDataFrame([(c, 1) for c in (0.01, 1.0, 2.9, 3.1, 30.0, 900.0)], "chi2 double, dof bigint")).collect()
    for r in got:
        assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(r["chi2"] / 2)), rel=1e-9)


def test_very_many_degrees(spark):
    cases = [(d + z * math.sqrt(2 * d), d) for d in (100_000, 1_000_000) for z in (-3.0, -0.5, -0.01, 0.01, 0.5, 3.0)]
    got = chi_square_p(spark.createDataFrame(cases, "chi2 double, dof bigint")).collect()
    for r in got:
        assert r["p_value"] == pytest.approx(even_tail(r["chi2"], r["dof"]), rel=1e-5)
