"""Row-level expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schema import NON_FEATURES, TIER_BOUNDS

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def flag(condition: Column) -> Column:
    """0/1 where an undecided comparison counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def wall_micros(ts: Column) -> Column:
    """Wall-clock microseconds since 1970-01-01, free of any session time zone."""
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * MICROS_PER_SECOND + (F.date_part(F.lit("SECOND"), ts) * MICROS_PER_SECOND).cast("bigint")


def wall_time(micros: Column) -> Column:
    """The inverse of ``wall_micros``."""
    seconds = (micros.cast("decimal(20,0)") / F.lit(MICROS_PER_SECOND).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def parse_timestamp(text: Column) -> Column:
    """ISO text to a wall-clock timestamp; unreadable text gives NULL."""
    return text.try_cast("timestamp_ntz")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing number on input; Spark would order it above all numbers."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def amount_features(mean: float, std: float, p95: float, p99: float) -> dict[str, Column]:
    amount = F.col("amount")
    return {
        "amount_zscore": (amount - F.lit(mean)) / F.lit(std),
        "amount_log": F.log1p(amount),
        "amount_is_round": flag(amount % 1 == 0),
        "amount_above_p95": flag(amount > F.lit(p95)),
        "amount_above_p99": flag(amount > F.lit(p99)),
    }


def calendar_features(ts: Column) -> dict[str, Column]:
    """Monday is day 0; business hours run through 17:59 on weekdays."""
    hour, day = F.hour(ts), F.weekday(ts)
    weekend = day >= 5
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": flag(weekend),
        "is_night": flag((hour < 6) | (hour >= 22)),
        "is_business_hours": flag(hour.between(9, 17) & ~weekend),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
    }


def risk_tier(score: Column, bounds: dict[str, float] | None = None) -> Column:
    """The highest tier whose lower bound the score reaches; below all of them, CLEAN."""
    chain = None
    for tier, bound in sorted((bounds or TIER_BOUNDS).items(), key=lambda kv: -kv[1]):
        reached = score >= F.lit(float(bound))
        chain = F.when(reached, tier) if chain is None else chain.when(reached, tier)
    return chain.otherwise("CLEAN")


def score_label(score: Column, threshold: float = 0.5) -> Column:
    return flag(score >= F.lit(float(threshold)))


def numeric_columns(df: DataFrame, exclude: set[str] | None = None) -> list[str]:
    """Numeric fields in schema order (booleans and timestamps do not count)."""
    skip = NON_FEATURES if exclude is None else exclude
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def align_to_contract(df: DataFrame, contract: list[str], keep: list[str] | None = None) -> DataFrame:
    """Contract columns in order as doubles: absent columns and nulls become 0.0."""
    present = set(df.columns)
    features = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)).alias(c) for c in contract
    ]
    return df.select(*(keep or []), *features)


def fixed(value: Column, digits: int) -> Column:
    """Number text with fixed decimals, rounded from the exact binary value (ties to even)."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def signed(value: Column, digits: int = 4) -> Column:
    """Number text that always carries its sign."""
    text = fixed(value, digits)
    return F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text))
