"""Feature engineering as an estimator/model pair.

``FeatureBuilder.fit`` learns category frequencies and numeric statistics;
``FeatureModel.transform`` adds the features. Wide rows are shuffled once, by
(user, instant): velocity and user profile are first joined on narrow rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.ordering import HEAVY_ROWS, column_quantiles, unpivot, user_quantiles
from riskloom.functions.scalars import amount_features, calendar_features, flag, nan_to_null, parse_timestamp, wall_micros
from riskloom.operators.trailing import empty_measures, trailing, velocity_measures
from riskloom.schema import CATEGORY_COLUMNS, STATS_COLUMNS
from riskloom.session import pin

# A frequency table up to this many rows is broadcast; beyond it the lookup is a shuffled join.
BROADCAST_ROWS = 100_000


def numeric_stats(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """(column, mean, std, p95, p99): sample deviation + 1e-9 and interpolated quantiles."""
    long = unpivot(df, columns).filter(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.avg("value").alias("mean"), (F.stddev_samp("value") + F.lit(1e-9)).alias("std")
    )
    if approx:
        marks = long.groupBy("column").agg(F.percentile_approx("value", [0.95, 0.99], 10_000).alias("q"))
        marks = marks.select("column", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"))
    else:
        marks = column_quantiles(df, columns, {"p95": 0.95, "p99": 0.99})
    return moments.join(marks, "column")


def category_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, freq): share of each value among the non-null values of its column."""
    long = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], columns, "column", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))  # one row per listed column
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "n", (F.col("n") / F.col("total")).alias("freq")
    )


def frequency_lookup(df: DataFrame, column: str, frequencies: DataFrame, small: bool) -> DataFrame:
    """Add ``<column>_freq``; values unseen at fit, and nulls, get 0."""
    table = frequencies.filter(F.col("column") == column).select(
        F.col("value").alias(column), F.col("freq").alias("_freq")
    )
    joined = df.join(F.broadcast(table) if small else table, column, "left")
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("_freq", F.lit(0.0)).alias(f"{column}_freq"))


DISTINCT_FEATURES = {
    "merchant_id": "unique_merchants",
    "ip_address": "unique_ips",
    "country": "_countries",
    "device_fingerprint": "unique_devices",
}


def user_profile(df: DataFrame, heavy_limit: int = HEAVY_ROWS) -> DataFrame:
    """Per user: median amount and distinct merchants, addresses, countries and devices.

    Distinct counts merge (user, value) pairs before the user's rows meet, so a heavy user
    is spread over its values.
    """
    present = [c for c in DISTINCT_FEATURES if c in df.columns]
    known = df.filter(F.col("user_id").isNotNull())
    counts = known.groupBy("user_id").agg(
        F.count("*").alias("_rows"), *[F.count_distinct(c).alias(DISTINCT_FEATURES[c]) for c in present]
    )
    medians = user_quantiles(df, "user_id", "amount", {"user_median": 0.5}, heavy_limit)
    return counts.join(medians, "user_id", "left").drop("_rows")


@dataclass
class FeatureBuilder:
    velocity_windows: list[int] = field(default_factory=lambda: [1, 7, 30])
    approx_quantiles: bool = False

    def fit(self, df: DataFrame) -> "FeatureModel":
        df = nan_to_null(df)
        spark = df.sparkSession
        categories = [c for c in CATEGORY_COLUMNS if c in df.columns]
        numerics = [c for c in STATS_COLUMNS if c in df.columns]
        stats = numeric_stats(df, numerics, self.approx_quantiles) if numerics else None
        # One row per listed column, so the driver may hold it.
        rows = {r["column"]: r.asDict() for r in stats.collect()} if stats is not None else {}
        if categories:
            freq = pin(category_frequencies(df, categories))
        else:
            freq = spark.createDataFrame([], "column string, value string, n bigint, freq double")
        # One row per listed column; each column is judged by its own number of values.
        values = dict(freq.groupBy("column").count().collect())
        small = [c for c in categories if values.get(c, 0) <= BROADCAST_ROWS]
        return FeatureModel(rows, freq, categories, list(self.velocity_windows), small)

    def transform(self, df: DataFrame) -> DataFrame:
        raise RuntimeError("Call fit() before transform().")

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass
class FeatureModel:
    stats: dict[str, dict]
    frequencies: DataFrame
    categories: list[str]
    velocity_windows: list[int]
    small_frequencies: list[str] = field(default_factory=list)  # columns whose values are few enough to broadcast
    heavy_limit: int = HEAVY_ROWS

    def transform(self, df: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Add all features the columns allow; ``history`` supplies earlier rows of the same users.

        Without history, the rows themselves are the only past they see.
        """
        df = nan_to_null(df)
        if "ts" not in df.columns and "timestamp" in df.columns:
            df = df.withColumn("ts", parse_timestamp(F.col("timestamp").cast("string")))
        past = df if history is None else df.unionByName(nan_to_null(history), allowMissingColumns=True)
        if history is not None:
            past = past.select(*df.columns)
        out = df
        out = self._by_user(out, past)
        amount = self.stats.get("amount", {"mean": 1.0, "std": 1.0, "p95": 1.0, "p99": 1.0})
        plain = amount_features(amount["mean"], amount["std"], amount["p95"], amount["p99"])
        if "ts" in df.columns:
            plain |= calendar_features(F.col("ts"))
        if "prior_fraud_count" in df.columns and "user_id" in df.columns:
            plain["is_repeat_fraudster"] = flag(F.col("prior_fraud_count") > 0)
        out = out.withColumns(plain)
        for column in self.categories:
            if column in df.columns:
                out = frequency_lookup(out, column, self.frequencies, column in self.small_frequencies)
        return out

    def _by_user(self, df: DataFrame, past: DataFrame) -> DataFrame:
        if "user_id" not in df.columns:
            return df
        profile = user_profile(past, self.heavy_limit)
        measures = velocity_measures(self.velocity_windows, F.col("amount")) if "ts" in df.columns else []
        if measures:
            moving = trailing(past, measures, heavy_limit=self.heavy_limit)
            # Rows without a time have no velocity but still have a profile.
            timeless = df.filter(F.col("ts").isNull() & F.col("user_id").isNotNull()).select("user_id").distinct()
            timeless = timeless.select("user_id", F.lit(None).cast("bigint").alias("_t"))
            facts = moving.unionByName(timeless, allowMissingColumns=True).join(profile, "user_id", "left")
            facts = facts.withColumnRenamed("user_id", "_user")
            rows = df.withColumn("_at", wall_micros(F.col("ts")))
            match = (F.col("user_id") == F.col("_user")) & F.col("_at").eqNullSafe(F.col("_t"))
            joined = rows.join(facts, match, "left").drop("_at", "_t", "_user")
        else:
            joined = df.join(profile, "user_id", "left")
        fill = empty_measures(measures)
        extra = {m.name: F.coalesce(F.col(m.name), fill[m.name]) for m in measures}
        extra["amount_vs_user_median"] = F.col("amount") / (F.col("user_median") + F.lit(1e-9))
        if "country" in df.columns:
            extra["multi_country_session"] = flag(F.col("_countries") > 1)
        if "device_fingerprint" in df.columns:
            extra["new_device"] = flag(F.col("unique_devices") > 3)
        return joined.withColumns(extra).drop("user_median", "_countries")

    # -- fitted state as tables ---------------------------------------------------------------

    def save(self, path: str) -> str:
        spark = self.frequencies.sparkSession
        rows = [(c, s["mean"], s["std"], s["p95"], s["p99"]) for c, s in self.stats.items()]
        schema = "column string, mean double, std double, p95 double, p99 double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/numeric_stats")
        self.frequencies.write.mode("overwrite").parquet(f"{path}/category_freq")
        setting = [(self.categories, self.velocity_windows, self.small_frequencies, self.heavy_limit)]
        schema = "categories array<string>, windows array<int>, small array<string>, heavy_limit bigint"
        spark.createDataFrame(setting, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureModel":
        stats = {r["column"]: r.asDict() for r in spark.read.parquet(f"{path}/numeric_stats").collect()}
        s = spark.read.parquet(f"{path}/settings").first()
        freq = spark.read.parquet(f"{path}/category_freq")
        return cls(stats, freq, list(s["categories"]), list(s["windows"]), list(s["small"]), s["heavy_limit"])
