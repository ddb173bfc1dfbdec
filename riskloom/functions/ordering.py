"""Running totals and exact quantiles that no single hot key can pull into one task.

Two forms of the same idea (sum inside a cell, then add what earlier cells hold):

* ``ordered_totals`` cuts the rows into range partitions of (keys, order). Balanced by
  Spark's own sampling, so it suits orders over few keys, where every key is large. At most
  one key continues across each partition border, hence the carried offsets number at most
  one per partition and may be broadcast. The cut is checkpointed, because the cell number
  must not change when a lost task is run again.
* ``user_quantiles`` keeps a light key whole and splits only heavy keys, in one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import pin

HEAVY_ROWS = 1_000_000


def heavy_keys(df: DataFrame, key: str, limit: int = HEAVY_ROWS) -> DataFrame:
    """Keys holding more than ``limit`` rows: at most rows/limit of them, so they may be broadcast."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > limit)
        .select(key, F.lit(True).alias("_heavy"))
    )


def ordered_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str],
    descending: bool = False,
    partitions: int | None = None,
    with_totals: bool = False,
) -> DataFrame:
    """Add ``<name>`` = running sum of column ``sums[name]`` up to and including the row.

    (keys, order) must be unique: group equal rows first. ``with_totals`` also adds
    ``<name>_all``, the sum over the whole key.
    """
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    by = [*[F.col(k) for k in keys], *direction]
    # Without a number, adaptive execution may merge neighbouring ranges of small inputs.
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    cut = pin(ranged.withColumn("_cell", F.spark_partition_id()))
    names = list(sums)
    per_cell = cut.groupBy(*keys, "_cell").agg(*[F.sum(sums[n]).alias(f"_{n}_cell") for n in names])
    whole = Window.partitionBy(*keys)
    # Range partition numbers rise with the (possibly descending) order itself.
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_cell.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_cell").alias("_kcell"),
        F.row_number().over(whole.orderBy("_cell")).alias("_rank"),
        *[F.sum(f"_{n}_cell").over(before).alias(f"_{n}_before") for n in names],
        *([F.sum(f"_{n}_cell").over(whole).alias(f"{n}_all") for n in names] if with_totals else []),
    )
    if not with_totals:
        carry = F.broadcast(carry.filter(F.col("_rank") > 1))
    carry = carry.drop("_rank")
    inside = Window.partitionBy(*keys, "_cell").orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_{n}_here": F.sum(sums[n]).over(inside) for n in names})
    match = F.col("_cell") == F.col("_kcell")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carry, match, "left")
    out = joined.withColumns({n: F.col(f"_{n}_here") + F.coalesce(F.col(f"_{n}_before"), F.lit(0)) for n in names})
    extra = [f"{n}_all" for n in names] if with_totals else []
    base = [c for c in df.columns if c not in names]
    return out.select(*base, *names, *extra)


def quantile_pick(quantiles: dict[str, float], total: str, running: str, count: str, value: str) -> list[Column]:
    """Aggregates that read linear-interpolated quantiles off counted, ranked values."""
    picks = []
    for name, q in quantiles.items():
        place = F.lit(float(q)) * (F.col(total) - 1)
        low = F.floor(place)
        high = F.ceil(place)
        first = F.col(running) - F.col(count)

        def holds(i: Column, first: Column = first) -> Column:
            return (i >= first) & (i < F.col(running))

        a = F.max(F.when(holds(low), F.col(value)))
        b = F.max(F.when(holds(high), F.col(value)))
        share = F.max(place - low)
        picks.append((a + (b - a) * share).alias(name))
    return picks


ACCURACY = 10_000  # of the approximate quantiles around an exact one: ranks are right to a part in so many


def column_quantiles(df: DataFrame, columns: list[str], quantiles: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles of several columns: one row per column that has a value, nulls skipped.

    One pass finds approximate marks on both sides of each quantile, a second counts what lies below them; only values
    between the marks are put in order. Should a mark be off, that quantile alone is looked for among all values.
    """
    wide = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    shares = sorted({min(1.0, max(0.0, q + d / accuracy)) for q in quantiles.values() for d in (-2, 2)})
    found = wide.agg(
        *[F.percentile_approx(f"v{i}", shares, accuracy).alias(f"m{i}") for i in range(len(columns))], *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]
    ).first()
    marks = []  # number, column, quantile, rank below, share between, lower and upper mark
    for i in range(len(columns)):
        for name, q in quantiles.items():
            if found[f"n{i}"]:
                place = q * (found[f"n{i}"] - 1)
                at = [found[f"m{i}"][shares.index(min(1.0, max(0.0, q + d / accuracy)))] for d in (-2, 2)]
                marks.append((len(marks), i, name, int(place), place - int(place), *at))
    spark = df.sparkSession
    if not marks:
        return spark.createDataFrame([], f"column string, {', '.join(f'{n} double' for n in quantiles)}")
    below = wide.agg(*[F.count_if(F.col(f"v{i}") < lo).alias(f"b{m}") for m, i, _, _, _, lo, _ in marks], *[
        F.count_if(F.col(f"v{i}") <= hi).alias(f"u{m}") for m, i, _, _, _, _, hi in marks
    ]).first()
    # Values around each place; a mark that does not hold lets everything in.
    held = {m: below[f"b{m}"] <= rank and rank + (rest > 0) < below[f"u{m}"] for m, _, _, rank, rest, _, _ in marks}
    inside = [
        F.when((F.col(f"v{i}") >= lo) & (F.col(f"v{i}") <= hi) if held[m] else F.col(f"v{i}").isNotNull(), F.struct(F.lit(m).alias("m"), F.col(f"v{i}").alias("value")))
        for m, i, _, _, _, lo, hi in marks
    ]
    near = wide.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).groupBy("x.m", "x.value").agg(F.count("*").alias("n"))
    ranked = ordered_totals(near, ["m"], ["value"], {"upto": "n"})
    table = F.broadcast(spark.createDataFrame(
        [(m, columns[i], name, rank - (below[f"b{m}"] if held[m] else 0), rest) for m, i, name, rank, rest, _, _ in marks],
        "m int, column string, name string, place long, share double",
    ))
    first = F.col("upto") - F.col("n")
    holds = lambda at: (at >= first) & (at < F.col("upto"))
    low, high = F.col("place"), F.col("place") + F.when(F.col("share") > 0, 1).otherwise(0)
    picked = ranked.join(table, "m").groupBy("column", "name").agg(
        F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"), F.max("share").alias("share")
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("share")
    return picked.groupBy("column").agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in quantiles])


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(kept columns, column, value) with values as doubles."""
    wide = df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(keep or [], columns, "column", "value")


def value_cell(value: Column, resolution: int = 4096) -> Column:
    """A coarse bucket that never falls as the value rises (about 0.02 % wide)."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value) * 1e6) * resolution)).cast("bigint")


def user_quantiles(
    df: DataFrame, key: str, value: str, quantiles: dict[str, float], heavy_limit: int = HEAVY_ROWS
) -> DataFrame:
    """Exact quantiles of ``value`` per ``key``, nulls skipped.

    Equal values merge before the shuffle. A key with more than ``heavy_limit`` rows is cut
    into value cells; only offsets per cell then meet in one window.
    """
    rows = df.select(key, F.col(value).cast("double").alias("_v")).filter(
        F.col(key).isNotNull() & F.col("_v").isNotNull()
    )
    counted = rows.groupBy(key, "_v").agg(F.count("*").alias("_n"))
    cells = counted.join(F.broadcast(heavy_keys(df, key, heavy_limit)), key, "left").withColumn(
        "_cell", F.when(F.col("_heavy"), value_cell(F.col("_v"))).otherwise(F.lit(0))
    )
    inside = Window.partitionBy(key, "_cell")
    local = cells.withColumns(
        {
            "_here": F.sum("_n").over(inside.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)),
            "_cell_n": F.sum("_n").over(inside),
        }
    )
    whole = Window.partitionBy(key)
    carry = (
        cells.filter("_heavy")
        .groupBy(key, "_cell")
        .agg(F.sum("_n").alias("_c"))
        .select(
            key,
            "_cell",
            F.sum("_c").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.sum("_c").over(whole).alias("_all"),
        )
    )
    ranked = local.join(carry, [key, "_cell"], "left").select(
        key,
        "_v",
        "_n",
        (F.col("_here") + F.coalesce("_before", F.lit(0))).alias("_upto"),
        F.coalesce("_all", "_cell_n").alias("_total"),
    )
    return ranked.groupBy(key).agg(*quantile_pick(quantiles, "_total", "_upto", "_n", "_v"))
