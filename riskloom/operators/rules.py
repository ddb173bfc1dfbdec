"""Policy rules over a transaction table. Every threshold is a parameter.

No rule holds a user's rows in one task: windows run through ``trailing``, sessions and runs
through ordered cells, first uses through grouped minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import ordered_totals, user_quantiles
from riskloom.functions.scalars import MICROS_PER_DAY, MICROS_PER_SECOND, flag, wall_micros, wall_time
from riskloom.operators.trailing import Trailing, with_trailing

HOUR = 3_600 * MICROS_PER_SECOND
# --- fixed values: the policy's risky categories ---
RISKY_CATEGORIES = ["crypto", "wire transfer", "gambling"]


def amount_velocity(df: DataFrame, n: int = 5, total: float = 2000.0, window: int = HOUR) -> DataFrame:
    """More than ``n`` transactions worth more than ``total`` in the window ending at the row."""
    measures = [
        Trailing("window_count", "count", window, F.lit(True), "both"),
        Trailing("window_total", "sum", window, F.col("amount"), "both"),
    ]
    found = with_trailing(df, measures)
    return found.filter((F.col("window_count") > n) & (F.col("window_total") > total))


def night_amount(df: DataFrame, amount: float = 500.0, first_hour: int = 1, last_hour: int = 5) -> DataFrame:
    hour = F.hour("ts")
    return df.filter((F.col("amount") > amount) & (hour >= first_hour) & (hour < last_hour))


def cross_border(df: DataFrame, n: int = 2, window: int = 2 * HOUR) -> DataFrame:
    """At least ``n`` countries within the window ending at the row."""
    return distinct_within(df, "country", window, "countries").filter(F.col("countries") >= n)


def distinct_within(df: DataFrame, column: str, window: int, name: str) -> DataFrame:
    """Add the number of distinct values of ``column`` the user showed in [t - window, t].

    A value counts from its use until the window has passed or it is used again, whichever
    is first; those spans of one value never overlap, so adding them up counts distinct values.
    """
    known = df.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    seen = (
        known.filter(F.col(column).isNotNull())
        .select("user_id", F.col(column).alias("_v"), wall_micros(F.col("ts")).alias("_t"))
        .distinct()
    )
    # Within one value's uses, the gap to the next use: numbered rows joined to their successor.
    placed = ordered_totals(seen.withColumn("_one", F.lit(1)), ["user_id", "_v"], ["_t"], {"_pos": "_one"})
    after = placed.select(
        F.col("user_id").alias("_u2"), F.col("_v").alias("_v2"), F.col("_t").alias("_next"), (F.col("_pos") - 1).alias("_p2")
    )
    spans = placed.join(
        after,
        (F.col("user_id") == F.col("_u2")) & (F.col("_v") == F.col("_v2")) & (F.col("_pos") == F.col("_p2")),
        "left",
    ).select("user_id", "_t", F.least(F.col("_t") + window + 1, F.col("_next")).alias("_end"))
    steps = (
        spans.select("user_id", F.explode(F.array(F.struct(F.col("_t").alias("_at"), F.lit(1).alias("_d")),
                                                  F.struct(F.col("_end").alias("_at"), F.lit(-1).alias("_d")))).alias("s"))
        .select("user_id", "s._at", "s._d")
        .unionByName(
            # Instants where the value is missing still need a reading.
            known.filter(F.col(column).isNull()).select("user_id", wall_micros(F.col("ts")).alias("_at"), F.lit(0).alias("_d"))
        )
        .groupBy("user_id", "_at")
        .agg(F.sum("_d").alias("_d"))
    )
    level = ordered_totals(steps, ["user_id"], ["_at"], {"_level": "_d"})
    level = level.select(F.col("user_id").alias("_user"), F.col("_at"), F.col("_level"))
    rows = df.withColumn("_t", wall_micros(F.col("ts")))
    exact = rows.join(level, (F.col("user_id") == F.col("_user")) & (F.col("_t") == F.col("_at")), "left")
    return exact.select(*df.columns, F.coalesce("_level", F.lit(0)).cast("bigint").alias(name))


def new_device_high_value(df: DataFrame, q: float = 0.95) -> DataFrame:
    """First use of a device by its user, with an amount above the user's ``q`` quantile."""
    order = F.struct(wall_micros(F.col("ts")).alias("_t"), F.col("transaction_id").alias("_id"))
    first = (
        df.filter(F.col("user_id").isNotNull() & F.col("device_fingerprint").isNotNull())
        .groupBy("user_id", "device_fingerprint")
        .agg(F.min(order).alias("_first"))
        .select("user_id", "device_fingerprint", F.col("_first._id").alias("transaction_id"))
    )
    firsts = df.join(first, ["user_id", "device_fingerprint", "transaction_id"], "left_semi")
    marks = user_quantiles(df, "user_id", "amount", {"user_mark": q})
    return firsts.join(marks, "user_id").filter(F.col("amount") > F.col("user_mark"))


def round_run(df: DataFrame, n: int = 3, window: int = 24 * HOUR, cents: int = 100) -> DataFrame:
    """The row that ends ``n`` consecutive round amounts of its user within the window.

    ``cents`` is the round unit. The run is read off two numbered rows: the one here and the
    one ``n - 1`` places back, which hold the running counts of rows and of round amounts.
    """
    is_round = flag(F.pmod(F.round(F.col("amount") * 100).cast("bigint"), F.lit(cents)) == 0)
    rows = (
        df.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
        .select("user_id", "transaction_id", wall_micros(F.col("ts")).alias("_t"), is_round.alias("_round"))
        .withColumn("_one", F.lit(1))
    )
    placed = ordered_totals(rows, ["user_id"], ["_t", "transaction_id"], {"_pos": "_one", "_rounds": "_round"})
    start = placed.filter(F.col("_round") == 1).select(
        F.col("user_id").alias("_u"),
        (F.col("_pos") + (n - 1)).alias("_p"),
        F.col("_t").alias("_t0"),
        (F.col("_rounds") - 1).alias("_r0"),
    )
    ends = (
        placed.filter(F.col("_round") == 1)
        .join(start, (F.col("user_id") == F.col("_u")) & (F.col("_pos") == F.col("_p")))
        .filter((F.col("_rounds") - F.col("_r0") == n) & (F.col("_t") - F.col("_t0") <= window))
        .select("user_id", "transaction_id")
    )
    return df.join(ends, ["user_id", "transaction_id"], "left_semi")


def category_mismatch(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """A user's first transaction in any risky category."""
    risky = df.filter(F.col("merchant_category").isin(categories or RISKY_CATEGORIES))
    order = F.struct(wall_micros(F.col("ts")).alias("_t"), F.col("transaction_id").alias("_id"))
    first = (
        risky.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.min(order).alias("_first"))
        .select("user_id", F.col("_first._id").alias("transaction_id"))
    )
    return risky.join(first, ["user_id", "transaction_id"], "left_semi")


def sessions(df: DataFrame, gap: int) -> DataFrame:
    """(user_id, instant, session_start) per distinct instant: a pause longer than ``gap`` opens a session."""
    instants = (
        df.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
        .select("user_id", wall_micros(F.col("ts")).alias("_t"))
        .distinct()
        .withColumn("_one", F.lit(1))
    )
    placed = ordered_totals(instants, ["user_id"], ["_t"], {"_pos": "_one"}).select("user_id", "_t", "_pos")
    before = placed.select(F.col("user_id").alias("_u"), (F.col("_pos") + 1).alias("_p"), F.col("_t").alias("_prev"))
    opened = placed.join(before, (F.col("user_id") == F.col("_u")) & (F.col("_pos") == F.col("_p")), "left")
    opened = opened.select("user_id", "_t", flag(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > gap)).alias("_open"))
    numbered = ordered_totals(opened, ["user_id"], ["_t"], {"_session": "_open"})
    return numbered.select("user_id", "_t", F.col("_session").alias("session"))


def multi_ip_sessions(df: DataFrame, n: int = 3, gap: int = 30 * 60 * MICROS_PER_SECOND) -> DataFrame:
    """Sessions of one user with more than ``n`` addresses."""
    found = sessions(df, gap).select(F.col("user_id").alias("_u"), F.col("_t").alias("_s"), "session")
    rows = df.select("user_id", "ip_address", wall_micros(F.col("ts")).alias("_t"))
    tagged = rows.join(found, (F.col("user_id") == F.col("_u")) & (F.col("_t") == F.col("_s")))
    out = tagged.groupBy("user_id", "session").agg(
        F.count_distinct("ip_address").alias("ips"),
        F.min("_t").alias("_start"),
        F.max("_t").alias("_end"),
        F.count("*").alias("transactions"),
    )
    return out.filter(F.col("ips") > n).select(
        "user_id",
        wall_time(F.col("_start")).alias("session_start"),
        wall_time(F.col("_end")).alias("session_end"),
        "ips",
        "transactions",
    )


def utilization_spike(df: DataFrame, high: float = 0.9, low: float = 0.4, window: int = 48 * HOUR) -> DataFrame:
    """Utilization above ``high`` where it was below ``low`` at some time in the window before."""
    was_low = Trailing("was_low", "seen", window, F.col("credit_utilization") < low)
    return with_trailing(df, [was_low]).filter((F.col("credit_utilization") > high) & F.col("was_low")).drop("was_low")


def declines_then_approval(df: DataFrame, n: int = 3, window: int = 30 * 60 * MICROS_PER_SECOND) -> DataFrame:
    """An approval with more than ``n`` declines of the same user in the window before it."""
    declines = Trailing("declines", "count", window, F.col("status") == "declined")
    return with_trailing(df, [declines]).filter((F.col("status") == "approved") & (F.col("declines") > n))


def prior_fraud_uplift(
    df: DataFrame, score: Column, uplift: float = 0.2, window: int = 365 * MICROS_PER_DAY
) -> DataFrame:
    """Add ``prior_fraud`` and ``uplifted_score``: score + uplift, at most 1, after recent confirmed fraud."""
    seen = Trailing("prior_fraud", "seen", window, F.col("is_fraud") == 1)
    raised = F.when(F.col("prior_fraud"), F.least(F.lit(1.0), score + F.lit(uplift))).otherwise(score)
    return with_trailing(df, [seen]).withColumn("uplifted_score", raised)


def route(df: DataFrame, score: str = "fraud_score") -> DataFrame:
    """Add ``action`` and, for review, ``review_due``. Blocking wins over step-up checks."""
    s = F.col(score)
    action = F.when(s >= 0.9, "BLOCK").when(s >= 0.7, "MFA").when(s >= 0.5, "REVIEW").otherwise("ALLOW")
    due = F.when((s >= 0.5) & (s < 0.7), F.col("ts") + F.make_dt_interval(hours=F.lit(4)))
    return df.withColumns({"action": action, "review_due": due})


def loss_filings(df: DataFrame, losses: float = 5000.0, days: int = 30) -> DataFrame:
    """Users whose confirmed fraud losses exceed the bound, with the filing date due after the last one."""
    confirmed = df.filter((F.col("is_fraud") == 1) & F.col("user_id").isNotNull())
    return (
        confirmed.groupBy("user_id")
        .agg(F.sum("amount").alias("fraud_losses"), F.max("ts").alias("last_fraud"))
        .filter(F.col("fraud_losses") > losses)
        .withColumn("filing_due", F.date_add(F.col("last_fraud").cast("date"), days))
    )
