"""Trailing-window measures per user: counts, sums and "seen within" tests in linear time.

A sliding RANGE frame costs its own length for every row. A window is instead the difference
of two running sums, up to t and up to t - window, which Spark keeps incrementally: all
measures of a user take one sort and one pass.

That still holds a user in one task. Heavy users are therefore cut into one-minute cells: each
instant enters once with +1 and leaves once per window with -1, running sums stay inside a
cell, and the totals of earlier cells carry over. Rows of one instant merge before the
shuffle, which bounds a cell by its microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ordering import HEAVY_ROWS, heavy_keys
from riskloom.functions.scalars import MICROS_PER_DAY, wall_micros

CELL_MICROS = 60 * 1_000_000
# Money is summed in decimals, so that entering and leaving cancel exactly; an amount that no such
# decimal holds (not finite, or 1e32 and more) adds nothing.
MONEY = "decimal(38,6)"


@dataclass(frozen=True)
class Trailing:
    """One measure over [t - window, t) of the same user (``closed="both"``: up to t itself).

    ``count`` counts rows meeting ``value`` (a condition), ``sum`` adds ``value``,
    ``seen`` tests whether any row met the condition.
    """

    name: str
    kind: str
    window: int
    value: Column
    closed: str = "left"


def velocity_measures(windows_days: list[int], amount: Column) -> list[Trailing]:
    out = []
    for days in windows_days:
        out.append(Trailing(f"txn_count_{days}d", "count", days * MICROS_PER_DAY, F.lit(True)))
        out.append(Trailing(f"txn_total_{days}d", "sum", days * MICROS_PER_DAY, amount))
    return out


def trailing(
    df: DataFrame,
    measures: list[Trailing],
    user: str = "user_id",
    ts: str = "ts",
    heavy_limit: int = HEAVY_ROWS,
    cell_micros: int = CELL_MICROS,
) -> DataFrame:
    """One row per distinct (user, instant ``_t``) with every measure; null users and times have none."""
    # Measures over the same expression share one input column.
    inputs: dict[str, tuple[str, Column]] = {}
    source: dict[str, str] = {}
    for m in measures:
        kind = "latest" if m.kind == "seen" else m.kind
        label = next((k for k, (kd, v) in inputs.items() if kd == kind and str(v) == str(m.value)), None)
        if label is None:
            label = f"_m{len(inputs)}"
            inputs[label] = (kind, m.value)
        source[m.name] = label

    def per_row(kind: str, value: Column) -> Column:
        if kind == "sum":
            return F.coalesce(value.try_cast(MONEY), F.lit(0).cast(MONEY))
        return F.coalesce(value.cast("int"), F.lit(0)).cast("bigint")

    rows = df.filter(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(
        user, wall_micros(F.col(ts)).alias("_t"), *[per_row(k, v).alias(c) for c, (k, v) in inputs.items()]
    )
    instants = rows.groupBy(user, "_t").agg(
        *[(F.max(c) if k == "latest" else F.sum(c)).alias(c) for c, (k, _) in inputs.items()]
    )
    tagged = instants.join(F.broadcast(heavy_keys(df, user, heavy_limit)), user, "left")
    light = _whole_users(tagged.filter(F.col("_heavy").isNull()), measures, source, user)
    split = _split_users(tagged.filter(F.col("_heavy")), measures, source, user, cell_micros)
    return light.unionByName(split)


def _finish(m: Trailing, total: Column, own: Column) -> Column:
    """A measure from what its window holds before t, and from the instant t itself."""
    if m.kind == "seen":
        found = F.coalesce(total >= F.col("_t") - m.window, F.lit(False))
        return (found | (own > 0)) if m.closed == "both" else found
    total = F.coalesce(total, F.lit(0))
    total = total + own if m.closed == "both" else total
    return total.cast("double") if m.kind == "sum" else total


def _whole_users(instants: DataFrame, measures: list[Trailing], source: dict[str, str], user: str) -> DataFrame:
    by_time = Window.partitionBy(user).orderBy("_t")

    def before(column: Column, gap: int) -> Column:
        return F.sum(column).over(by_time.rangeBetween(Window.unboundedPreceding, -gap))

    def held(m: Trailing) -> Column:
        c = F.col(source[m.name])
        if m.kind == "seen":
            return F.max(F.when(c > 0, F.col("_t"))).over(by_time.rangeBetween(Window.unboundedPreceding, -1))
        return before(c, 1) - F.coalesce(before(c, m.window + 1), F.lit(0))

    return instants.select(user, "_t", *[_finish(m, held(m), F.col(source[m.name])).alias(m.name) for m in measures])


def _split_users(
    instants: DataFrame, measures: list[Trailing], source: dict[str, str], user: str, cell_micros: int
) -> DataFrame:
    spans = sorted({m.window for m in measures if m.kind != "seen"})
    moves = (
        instants.withColumn("_span", F.explode(F.array(*[F.lit(s).cast("bigint") for s in [0, *spans]])))
        .withColumn("_at", F.col("_t") + F.col("_span"))
        .withColumn("_cell", F.floor(F.col("_at") / cell_micros))
    )

    def step(m: Trailing) -> Column:
        c = F.col(source[m.name])
        if m.kind == "seen":
            return F.when((F.col("_span") == 0) & (c > 0), F.col("_at"))
        return F.when(F.col("_span") == 0, c).when(F.col("_span") == m.window, -c).otherwise(F.lit(0))

    def fold(m: Trailing) -> Column:
        return F.max(step(m)) if m.kind == "seen" else F.sum(step(m))

    earlier = Window.partitionBy(user, "_cell").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    inputs = sorted(set(source.values()))
    local = moves.select(
        user, "_cell", "_t", "_span", *inputs, *[fold(m).over(earlier).alias(f"_in_{m.name}") for m in measures]
    ).filter(F.col("_span") == 0)
    cells_before = Window.partitionBy(user).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        moves.groupBy(user, "_cell")
        .agg(*[fold(m).alias(f"_c_{m.name}") for m in measures])
        .select(
            user,
            "_cell",
            *[
                (F.max if m.kind == "seen" else F.sum)(f"_c_{m.name}").over(cells_before).alias(f"_b_{m.name}")
                for m in measures
            ],
        )
    )
    joined = local.join(carry, [user, "_cell"], "left")

    def held(m: Trailing) -> Column:
        inside, before = F.col(f"_in_{m.name}"), F.col(f"_b_{m.name}")
        if m.kind == "seen":
            return F.greatest(inside, before)
        return F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0))

    return joined.select(user, "_t", *[_finish(m, held(m), F.col(source[m.name])).alias(m.name) for m in measures])


def empty_measures(measures: list[Trailing]) -> dict[str, Column]:
    """What a row without a user or a time gets."""
    fill = {"count": F.lit(0).cast("bigint"), "sum": F.lit(0.0), "seen": F.lit(False)}
    return {m.name: fill[m.kind] for m in measures}


def with_trailing(df: DataFrame, measures: list[Trailing], user: str = "user_id", ts: str = "ts", **options) -> DataFrame:
    """The rows of ``df`` with their trailing measures, joined by (user, instant)."""
    found = trailing(df, measures, user, ts, **options).withColumnRenamed(user, "_user")
    rows = df.withColumn("_at", wall_micros(F.col(ts)))
    joined = rows.join(found, (F.col(user) == F.col("_user")) & (F.col("_at") == F.col("_t")), "left")
    fill = empty_measures(measures)
    return joined.select(
        *df.columns, *[F.coalesce(F.col(m.name), fill[m.name]).alias(m.name) for m in measures]
    )
