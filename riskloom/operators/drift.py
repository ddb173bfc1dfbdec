"""Drift between a reference and a current batch, as grouped counts over both."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.ordering import ordered_totals, unpivot
from riskloom.functions.scalars import numeric_columns

MIN_SAMPLE = 10
P_VALUE = 0.05
EXACT_ROWS = 10_000  # of a sample, up to which p-values are exact


def set_reference(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_reference(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored reference; None where nothing has been stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def shared_numeric(current: DataFrame, reference: DataFrame) -> list[str]:
    """Numeric columns of the current batch that the reference has too, in current order."""
    known = set(reference.columns)
    return [c for c in numeric_columns(current, exclude=set()) if c in known]


def sided(reference: DataFrame, current: DataFrame, columns: list[str], text: bool = False) -> DataFrame:
    """(column, value, in_ref, in_cur) counts: equal values merge before anything is sorted."""

    def long(df: DataFrame, side: int) -> DataFrame:
        if text:
            out = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], columns, "column", "value")
        else:
            out = unpivot(df, columns)
        return out.withColumn("side", F.lit(side))

    both = long(reference, 0).unionByName(long(current, 1)).filter(F.col("value").isNotNull())
    if not text:
        both = both.filter(~F.isnan("value"))
    return both.groupBy("column", "value").agg(
        F.count_if(F.col("side") == 0).alias("in_ref"), F.count_if(F.col("side") == 1).alias("in_cur")
    )


def kolmogorov_p(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value; the series is cut at 100 terms, far past double precision."""
    lam = statistic * F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    series = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) * 2.0
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def exact_p(statistic: float, n1: int, n2: int) -> float:
    """Share of all orders of two samples without ties whose distribution functions come at least this far apart.

    Orders are paths through a lattice of n1 by n2 steps; the paths that stay closer are counted row by row.
    """
    apart = round(statistic * n1 * n2)  # distances are whole multiples of 1 / (n1 n2)
    if apart <= 0:
        return 1.0
    ways, scale = np.zeros(n2 + 1), 0.0
    ways[0] = 1.0
    for i in range(n1 + 1):
        low = max(0, -((apart - 1 - i * n2) // n1))
        high = min(n2, (i * n2 + apart - 1) // n1)
        if low > high:
            return 1.0
        new = np.zeros(n2 + 1)
        new[low : high + 1] = np.cumsum(ways[low : high + 1])
        top = new.max()
        if top <= 0:
            return 1.0
        ways, scale = new / top, scale + np.log(top)
    if ways[n2] <= 0:
        return 1.0
    all_orders = lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1)
    return float(min(1.0, max(0.0, 1.0 - np.exp(scale + np.log(ways[n2]) - all_orders))))


def _exact(statistic: Column, n1: Column, n2: Column) -> Column:
    @F.arrow_udf("double")
    def p(d: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([exact_p(*x) for x in zip(d.to_pylist(), a.to_pylist(), b.to_pylist())], pa.float64())

    return p(statistic, n1, n2)


def ks_test(
    reference: DataFrame, current: DataFrame, columns: list[str] | None = None, min_sample: int = MIN_SAMPLE,
    p_value: float = P_VALUE, exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """(column, n_ref, n_cur, ks, p_value, drifted), columns with fewer than ``min_sample`` values left out.

    The p-value is exact where neither sample has more than ``exact_rows`` values, else the asymptotic one.
    """
    columns = columns or shared_numeric(current, reference)
    return _compared(sided(reference, current, columns), min_sample, p_value, exact_rows)


def ks_by_key(
    reference: DataFrame, current: DataFrame, key: str, value: str, min_sample: int = MIN_SAMPLE, p_value: float = P_VALUE,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """The test of ``ks_test`` for the values of each key, such as a user's amounts: (key, n_ref, n_cur, ks, p_value, drifted)."""
    rows = lambda df, side: df.select(F.col(key).alias("column"), F.col(value).cast("double").alias("value"), F.lit(side).alias("side"))
    both = rows(reference, 0).unionByName(rows(current, 1)).filter(F.col("column").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    counted = both.groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("in_ref"), F.count_if(F.col("side") == 1).alias("in_cur"))
    return _compared(counted, min_sample, p_value, exact_rows).withColumnRenamed("column", key)


def _compared(counted: DataFrame, min_sample: int, p_value: float, exact_rows: int) -> DataFrame:
    ranked = ordered_totals(counted, ["column"], ["value"], {"ref": "in_ref", "cur": "in_cur"}, with_totals=True)
    gap = F.abs(F.col("ref").cast("double") / F.col("ref_all") - F.col("cur").cast("double") / F.col("cur_all"))
    tested = (
        ranked.filter((F.col("ref_all") >= min_sample) & (F.col("cur_all") >= min_sample))
        .groupBy("column")
        .agg(F.max("ref_all").alias("n_ref"), F.max("cur_all").alias("n_cur"), F.max(gap).alias("ks"))
    )
    with_p = tested.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur")))
    if exact_rows:
        small = (F.col("n_ref") <= exact_rows) & (F.col("n_cur") <= exact_rows)
        sizes = [F.when(small, F.col(c)).otherwise(1) for c in ("n_ref", "n_cur")]
        with_p = with_p.withColumn("p_value", F.when(small, _exact(F.col("ks"), *sizes)).otherwise(F.col("p_value")))
    return with_p.withColumn("drifted", F.col("p_value") < p_value)


def chi_square(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """(column, chi2, dof): homogeneity of a text column across the two batches."""
    cells = sided(reference, current, columns, text=True)
    totals = cells.groupBy("column").agg(F.sum("in_ref").alias("r"), F.sum("in_cur").alias("c"))
    joined = cells.join(F.broadcast(totals), "column")  # one row per listed column
    seen = (F.col("in_ref") + F.col("in_cur")).cast("double")
    whole = (F.col("r") + F.col("c")).cast("double")

    def part(observed: str, side: str) -> Column:
        expected = seen * F.col(side) / whole
        return F.try_divide((F.col(observed) - expected) * (F.col(observed) - expected), expected)

    return joined.groupBy("column").agg(
        F.sum(F.coalesce(part("in_ref", "r"), F.lit(0.0)) + F.coalesce(part("in_cur", "c"), F.lit(0.0))).alias("chi2"),
        (F.count("*") - 1).alias("dof"),
    )


GAMMA_STEPS = 500


def chi_square_p(tests: DataFrame) -> DataFrame:
    """Add ``p_value`` = upper tail of the chi-square law.

    Below the mean by the series of the incomplete gamma function, above it by its continued
    fraction, both with ``GAMMA_STEPS`` terms and 12 more for each unit of the root of the degrees of
    freedom, and factors as logs, so any statistic is safe.
    """
    half, x = F.col("dof") / 2.0, F.col("chi2") / 2.0
    # P(a, x) = x^a e^-x / Gamma(a + 1) * sum_k x^k / ((a+1)...(a+k)); Gamma by its log, built up from 1 or 1/2.
    log_gamma = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(half).cast("int"))),
        F.when(F.col("dof") % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5723649429247001)),
        lambda acc, i: acc + F.when(i - F.when(F.col("dof") % 2 == 0, 0.0).otherwise(0.5) <= half,
                                    F.log(i - F.when(F.col("dof") % 2 == 0, 0.0).otherwise(0.5))).otherwise(0.0),
    )
    steps = F.sequence(F.lit(1), (F.lit(GAMMA_STEPS) + F.ceil(12 * F.sqrt(F.col("dof").cast("double")))).cast("int"))
    series = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * x / (half + k)).alias("term"), (acc["total"] + acc["term"] * x / (half + k)).alias("total")
        ),
    )["total"]
    # Q(a, x) = x^a e^-x / Gamma(a) / (x + 1 - a - 1 (1 - a) / (x + 3 - a - 2 (2 - a) / (x + 5 - a - ...))), from the inside out.
    down = F.aggregate(
        F.sequence(F.lit(GAMMA_STEPS), F.lit(1), F.lit(-1)), F.lit(0.0),
        lambda acc, k: k * (k - half) / (x + (2 * k + 1) - half - acc),
    )
    factor = half * F.log(x) - x - log_gamma
    upper = F.exp(factor + F.log(half)) / (x + 1.0 - half - down)
    tail = F.when(F.col("chi2") <= 0, 1.0).when(x < half + 1, 1.0 - F.exp(factor) * series).otherwise(upper)
    tail = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))
    return tests.withColumn("p_value", F.when(F.col("dof") < 1, F.lit(None)).otherwise(tail))


def dataset_drift(tests: DataFrame, rule: str = "share", threshold: float = 0.15) -> DataFrame:
    """One row: tested and drifted columns and the verdict by share of columns, or by any column."""
    out = tests.agg(
        F.count("*").alias("n_tested"),
        F.count_if("drifted").alias("n_drifted"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("column")))).alias("drifted_features"),
    )
    share = F.coalesce(F.try_divide(F.col("n_drifted").cast("double"), F.col("n_tested")), F.lit(0.0))
    verdict = (share >= threshold) & (F.col("n_tested") > 0) if rule == "share" else F.col("n_drifted") > 0
    return out.withColumn("dataset_drift", verdict)


def score_shift(reference: DataFrame, current: DataFrame, score: str = "fraud_score") -> DataFrame:
    """One row: current mean minus reference mean, 0 when either lacks the score."""
    spark = current.sparkSession
    if score not in reference.columns or score not in current.columns:
        return spark.range(1).select(F.lit(0.0).alias("score_shift"))
    both = reference.select(F.col(score), F.lit(0).alias("side")).unionByName(
        current.select(F.col(score), F.lit(1).alias("side"))
    )
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col(score)))
    return both.agg((mean(1) - mean(0)).alias("score_shift"))


def _missing(df: DataFrame, column: str) -> Column:
    gone = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        gone = gone | F.isnan(column)
    return gone


def missing_ratio(df: DataFrame) -> DataFrame:
    """One row: missing cells over all cells, 4 digits, 0 for an empty table."""
    cells = F.count("*") * len(df.columns)
    gone = sum((F.count_if(_missing(df, c)) for c in df.columns[1:]), F.count_if(_missing(df, df.columns[0])))
    return df.agg(F.coalesce(F.round(F.try_divide(gone.cast("double"), cells), 4), F.lit(0.0)).alias("missing_ratio"))


def missing_by_column(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, missing_ref, missing_cur) over the columns both have."""
    shared = [c for c in current.columns if c in set(reference.columns)]

    def counts(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in shared])
        return one.unpivot([], shared, "column", name)

    # One row per column on both sides.
    return counts(reference, "missing_ref").join(F.broadcast(counts(current, "missing_cur")), "column")


def drift_summary(
    reference: DataFrame,
    current: DataFrame,
    columns: list[str] | None = None,
    drift_threshold: float = 0.15,
    score_shift_threshold: float = 0.05,
    rule: str = "share",
) -> DataFrame:
    """The one-row report of a run. Each part is a one-row aggregate, so the cross joins join single rows."""
    verdict = dataset_drift(ks_test(reference, current, columns), rule, drift_threshold)
    size = current.agg(F.count("*").alias("batch_size"))
    row = verdict.crossJoin(score_shift(reference, current)).crossJoin(missing_ratio(current)).crossJoin(size)
    drifted = F.col("dataset_drift") | (F.abs(F.coalesce("score_shift", F.lit(0.0))) > score_shift_threshold)
    return row.select(
        "batch_size",
        drifted.alias("drift_detected"),
        "dataset_drift",
        "n_tested",
        "n_drifted",
        "drifted_features",
        "score_shift",
        "missing_ratio",
    )
