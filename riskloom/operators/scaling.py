"""Standard scaling and fixed-range normalisation from one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Scaler:
    """Mean 0 and population deviation 1; a constant column is only shifted."""

    columns: list[str]
    means: list[float]
    deviations: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "Scaler":
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(columns)],
        ).first()
        n = range(len(columns))
        means = [float(row[f"m{i}"] or 0.0) for i in n]
        # Rounding leaves a constant column a deviation near, but not at, zero.
        raw = [float(row[f"d{i}"] or 0.0) for i in n]
        deviations = [d if d > 1e-12 * max(1.0, abs(m)) else 1.0 for d, m in zip(raw, means)]
        return cls(list(columns), means, deviations)

    def column(self, name: str) -> Column:
        i = self.columns.index(name)
        return (F.col(name) - F.lit(self.means[i])) / F.lit(self.deviations[i])

    def vector(self) -> Column:
        return F.array(*[self.column(c).cast("double") for c in self.columns])


def score_range(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of each score."""
    row = df.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    return {n: (float(row[f"lo_{n}"]), float(row[f"hi_{n}"])) for n in names}


def normalise(value: Column, low: float, high: float) -> Column:
    """Share of the fitted range; 0 throughout when the range is a single value."""
    return F.lit(0.0) if low == high else (value - F.lit(low)) / F.lit(high - low)
