"""Exact per-row feature contributions of boosted trees, path-dependent Shapley values.

Each leaf is a small game over the features on its path: a feature in the coalition lets the
row through only if it meets the path's interval, one outside lets through the share of
training rows that did. Summing the closed form of that game over leaves and trees gives the
values; contributions and base value add up to the log-odds of the model.

The values depend on a row only through the few decisions above and below a node, so they are tabulated at fit for
every outcome of those decisions. A row then only compares and looks up.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.evidence import top_contributions
from riskloom.operators.neighbors import matrix_of
from riskloom.operators.trees import Bins, Trees, codes_of

BELOW = 2  # levels of decisions that share a table with those above them
ROWS_AT_ONCE = 1024


def path_values(x: np.ndarray, paths: list[tuple]) -> tuple[np.ndarray, float]:
    """(rows x features contributions, base value); paths as plain tuples."""
    out = np.zeros_like(x, dtype=np.float64)
    base = 0.0
    for leaf, features, low, high, share in paths:
        m = len(features)
        base += leaf * float(np.prod(share))
        if m == 0:
            continue
        values = x[:, features]
        meets = ((values > low) & (values <= high)).astype(np.float64)
        weights = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
        for i in range(m):
            # Coefficient s: total weight of coalitions of s other features.
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    shifted = np.zeros_like(poly)
                    shifted[:, 1:] = poly[:, :-1] * meets[:, j : j + 1]
                    poly = poly * share[j] + shifted
            out[:, features[i]] += leaf * (meets[:, i] - share[i]) * (poly @ weights)
    return out, base


@dataclass
class Stem:
    """The leaves below one node: their features, the decisions met on the way, and values by the decisions' outcome."""

    features: list[int]
    decisions: list[tuple[int, int]]  # feature and cut, first decision first
    table: np.ndarray  # features x 2 ** decisions; bit k of the column is set if decision k goes left
    base: float


def stems(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, cover: np.ndarray) -> list[Stem]:
    """Tables of one tree. A leaf whose path has m features costs 2^m terms of its game, once."""
    height: dict[int, int] = {}
    order, pending = [], [(0, ())]
    while pending:  # nodes with the decisions above them, as (node, whether left)
        node, path = pending.pop()
        order.append((node, path))
        if feature[node] >= 0:
            pending += [(int(left[node]), (*path, (node, True))), (int(right[node]), (*path, (node, False)))]
    for node, _ in reversed(order):
        height[node] = 0 if feature[node] < 0 else 1 + max(height[int(left[node])], height[int(right[node])])
    out, inside = [], set()
    for node, path in order:
        if any(n in inside for n, _ in path):
            continue
        if height[node] > BELOW:
            continue
        inside.add(node)
        out.append(_stem(node, path, feature, cut, left, right, value, cover))
    return out


def _stem(top: int, above: tuple, feature, cut, left, right, value, cover) -> Stem:
    leaves, pending, met = [], [(top, above)], [n for n, _ in above]
    while pending:
        node, path = pending.pop()
        if feature[node] < 0:
            leaves.append((node, path))
            continue
        met.append(node)
        pending += [(int(left[node]), (*path, (node, True))), (int(right[node]), (*path, (node, False)))]
    bit = {n: k for k, n in enumerate(met)}
    features = sorted({int(feature[n]) for n in met})
    column = {f: i for i, f in enumerate(features)}
    outcomes = np.arange(1 << len(met))
    table, base = np.zeros((len(outcomes), len(features))), 0.0
    for leaf, path in leaves:
        own = sorted({int(feature[n]) for n, _ in path})
        meets, share = np.ones((len(outcomes), len(own))), np.ones(len(own))
        for n, goes_left in path:
            i = own.index(int(feature[n]))
            meets[:, i] *= ((outcomes >> bit[n]) & 1) == goes_left
            child = left[n] if goes_left else right[n]
            share[i] *= cover[child] / cover[n] if cover[n] > 0 else 0.0
        values, part = path_values(meets, [(float(value[leaf]), np.arange(len(own)), np.full(len(own), 0.5), np.full(len(own), np.inf), share)])
        table[:, [column[f] for f in own]] += values
        base += part
    return Stem(features, [(int(feature[n]), int(cut[n])) for n in met], np.ascontiguousarray(table.T), base)


def table_values(codes: np.ndarray, found: list[tuple]) -> np.ndarray:
    """(features x rows) contributions of binned rows; ``found`` has features, decisions and table of each stem."""
    flat = np.ascontiguousarray(codes.T)
    out = np.zeros(flat.shape)
    goes: dict[tuple[int, int], np.ndarray] = {}
    for features, decisions, table in found:
        at = np.zeros(len(codes), np.int64)
        for k, (f, c) in enumerate(decisions):
            if (f, c) not in goes:
                goes[f, c] = (flat[f] <= c).astype(np.int64)
            at += goes[f, c] << k
        for i, f in enumerate(features):
            out[f] += table[i][at]
    return out


@dataclass
class Explainer:
    feature_names: list[str]
    stems: list[Stem]
    bins: Bins
    base_value: float

    @classmethod
    def fit(cls, spark: SparkSession, trees: Trees, bins: Bins, feature_names: list[str]) -> "Explainer":
        """Tabulates the trees, a task for some of them; the tables' size is bounded by the number and depth of the trees."""
        given = [(pickle.dumps([getattr(trees, c)[t] for c in ("feature", "cut", "left", "right", "value", "cover")]),) for t in range(len(trees))]

        def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [pickle.dumps([(s.features, s.decisions, s.table, s.base) for s in stems(*pickle.loads(t))]) for t in batch.column("tree").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["stems"])

        made = spark.createDataFrame(given, "tree binary").repartition(spark.sparkContext.defaultParallelism).mapInArrow(tabulate, "stems binary")
        found = [Stem(*s) for r in made.collect() for s in pickle.loads(bytes(r["stems"]))]
        return cls(list(feature_names), found, bins, sum(s.base for s in found))

    def explain(self, df: DataFrame, vector: str = "features", max_display: int = 10) -> DataFrame:
        """Add ``contributions`` (map of the strongest features) and ``base_value``."""
        shipped = df.sparkSession.sparkContext.broadcast((self.bins.edges, [(s.features, s.decisions, s.table) for s in self.stems]))

        @F.arrow_udf("array<double>")
        def values(features: pa.Array) -> pa.Array:
            edges, found = shipped.value
            codes = codes_of(edges, matrix_of(features))
            parts = [table_values(codes[i : i + ROWS_AT_ONCE], found).T for i in range(0, len(codes), ROWS_AT_ONCE)]
            flat = np.concatenate(parts) if parts else np.zeros((0, codes.shape[1]))
            ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

        named = F.map_from_arrays(F.array(*[F.lit(n) for n in self.feature_names]), F.col("_values"))
        top = top_contributions(named, max_display)
        return (
            df.withColumn("_values", values(vector))
            .withColumn("contributions", F.map_from_entries(top))
            .withColumn("base_value", F.lit(self.base_value))
            .drop("_values")
        )
