"""Three unsupervised detectors and their composite score.

* isolation forest: hash-sampled rows per tree, one task per tree, node arrays shipped to the scorer;
* local outlier factor: exact neighbours by a fitted ``NeighborIndex``, densities by joins;
* one-class support vector machine: random Fourier features and conditional-gradient steps,
  each step two aggregates (an approximation of the kernel machine, not an exact solver).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.neighbors import NeighborIndex, _matrix, matrix_of
from riskloom.operators.scaling import Scaler, normalise, score_range
from riskloom.session import pin

# --- fixed values: composite weights and detector settings ---
WEIGHTS = {"if": 0.5, "lof": 0.3, "ocsvm": 0.2}
SAMPLE_ROWS = 256
NEIGHBORS = 20
NU = 0.5

GAP = 1e-3  # duality gap, as a share of the squared length, at which the one-class fit ends
MOST_STEPS = 500
CELLS = 64  # of the scores around the bound of the outliers


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        deep = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


# -- isolation forest -----------------------------------------------------------------------------

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def tree_samples(df: DataFrame, n_trees: int, sample: int, seed: int, rows: int) -> DataFrame:
    """(tree, id, features): ``sample`` distinct rows per tree, chosen by hash.

    Each row draws for R residues of the tree number and joins at most one tree per residue;
    R is 1 on large tables, so a row is hashed once, and grows to one per tree on small ones.
    """
    sample = min(sample, rows)
    residues = int(min(n_trees, max(1, -(-2 * n_trees * sample // rows))))
    per_residue = -(-n_trees // residues)
    share = 1.0 if residues == n_trees else min(1.0, 1.6 * sample * n_trees / (rows * residues))
    draws = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(residues - 1)))).withColumn(
        "_h", F.pmod(F.xxhash64("id", "_j", F.lit(seed)), F.lit(1 << 40))
    )
    kept = draws.filter(F.col("_h") < int(share * (1 << 40)))
    tree = F.col("_j") + residues * F.pmod(F.xxhash64("id", "_j", F.lit(seed + 1)), F.lit(per_residue))
    kept = kept.withColumn("tree", tree.cast("int")).filter(F.col("tree") < n_trees)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_h", "id"))
    return kept.withColumn("_p", place).filter(F.col("_p") <= sample).select("tree", "id", "features")


def _grow(seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tree = int(pdf["tree"].iat[0])
        x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list] = []
        pending = [(np.arange(len(x)), 0, -1, "")]
        while pending:
            rows, depth, parent, side = pending.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][4 if side == "l" else 5] = me
            part = x[rows]
            low, high = part.min(0), part.max(0)
            choices = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(choices) == 0:
                nodes.append([tree, me, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
                continue
            f = int(rng.choice(choices))
            cut = float(rng.uniform(low[f], high[f]))
            nodes.append([tree, me, f, cut, -1, -1, 0.0])
            goes = part[:, f] <= cut
            pending.append((rows[~goes], depth + 1, me, "r"))
            pending.append((rows[goes], depth + 1, me, "l"))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    return grow


@dataclass
class IsolationForest:
    nodes: DataFrame
    sample: int
    n_trees: int

    @classmethod
    def fit(cls, df: DataFrame, n_trees: int = 200, seed: int = 42, rows: int | None = None) -> "IsolationForest":
        rows = rows or df.count()
        sample = min(SAMPLE_ROWS, rows)
        samples = tree_samples(df, n_trees, sample, seed, rows)
        nodes = pin(samples.groupBy("tree").applyInPandas(_grow(seed), NODE_SCHEMA))
        return cls(nodes, sample, n_trees)

    def scorer(self):
        """Column function over ``features``; the forest has at most trees x 2 x sample nodes."""
        table = self.nodes.orderBy("tree", "node").toPandas()
        trees = [
            tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")) for _, t in table.groupby("tree")
        ]
        shipped = self.nodes.sparkSession.sparkContext.broadcast(trees)
        scale = float(average_path(self.sample)) or 1.0

        @F.arrow_udf("double")
        def score(features: pa.Array) -> pa.Array:
            x = matrix_of(features)
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, threshold, left, right, path in shipped.value:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes = x[every, np.maximum(f, 0)] <= threshold[at]
                    at = np.where(inner, np.where(goes, left[at], right[at]), at)
                total += path[at]
            return pa.array(2.0 ** (-total / len(shipped.value) / scale))

        return score


# -- local outlier factor -------------------------------------------------------------------------


@dataclass
class LocalOutlierFactor:
    index: NeighborIndex
    density: DataFrame  # id, kdist, lrd
    k: int
    known: DataFrame | None = None  # what the index answers for the fitted vectors

    @classmethod
    def fit(cls, df: DataFrame, k: int = NEIGHBORS, rows: int | None = None) -> "LocalOutlierFactor":
        rows = rows or df.count()
        k = max(1, min(k, rows - 1))
        index = NeighborIndex.fit(df, k)
        known = pin(index.answers(df, k + 1))
        near = pin(index.search(df, k, exclude_self=True, known=known))
        kdist = near.groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("kdist"))
        density = pin(_reach_density(near, kdist).join(kdist, "id").select("id", "kdist", "lrd"))
        return cls(index, density, k, known)

    def score(self, df: DataFrame) -> DataFrame:
        """(id, s_lof): mean neighbour density over own density. Fitted rows meet themselves, as new rows would."""
        near = self.index.search(df, self.k, known=self.known)
        side = self.density.select(F.col("id").alias("neighbor_id"), F.col("kdist").alias("_kd"), "lrd")
        around = near.join(side, "neighbor_id").groupBy(F.col("query_id").alias("id")).agg(
            F.avg("lrd").alias("_around"), (F.lit(1.0) / (F.avg(F.greatest("distance", "_kd")) + 1e-10)).alias("_own")
        )
        return around.select("id", (F.col("_around") / F.col("_own")).alias("s_lof"))


def _reach_density(near: DataFrame, kdist: DataFrame) -> DataFrame:
    """(id, lrd): inverse mean reachability distance to the neighbours (+1e-10 as the usual guard)."""
    side = kdist.select(F.col("id").alias("neighbor_id"), F.col("kdist").alias("_kd"))
    reach = near.join(side, "neighbor_id").withColumn("_reach", F.greatest("distance", "_kd"))
    return reach.groupBy(F.col("query_id").alias("id")).agg((F.lit(1.0) / (F.avg("_reach") + 1e-10)).alias("lrd"))


# -- one-class support vector machine -------------------------------------------------------------


@dataclass
class OneClassSvm:
    """The mean of feature maps nearest to the origin in which no row weighs more than 1 / (nu n).

    ``gap`` bounds how far its half squared length is from the least possible; ``steps`` passes led there.
    """

    projection: np.ndarray  # width x D
    phase: np.ndarray
    weights: np.ndarray
    offset: float
    gap: float = float("nan")
    steps: int = 0

    @classmethod
    def fit(
        cls, df: DataFrame, width: int, nu: float = NU, dims: int = 256, tolerance: float = GAP, most: int = MOST_STEPS, seed: int = 42
    ) -> "OneClassSvm":
        """Conditional gradients with away steps, one pass over the rows a step, until the duality gap is at most
        ``tolerance`` of the squared length. ``most`` steps without that are an error, not a result.
        """
        rng = np.random.default_rng(seed)
        gamma = 1.0 / width
        projection = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, dims))
        phase = rng.uniform(0.0, 2.0 * np.pi, dims)
        zone = (-np.inf, np.inf)
        mean, n = cls._sums(df, projection, phase, None, zone)[:2]
        atoms, shares = [mean / n], [1.0]
        for step in range(1, most + 1):
            weights = np.array(shares) @ np.array(atoms)
            # The rows of the lowest nu share of scores are the vertex that pulls the weights furthest.
            target, offset, slack, zone = cls._lowest(df, projection, phase, weights, zone, nu * n)
            gap = float(weights @ (weights - target)) + slack
            if gap <= tolerance * float(weights @ weights):
                return cls(projection, phase, weights, float(offset), gap, step)
            away = int(np.argmax([a @ weights for a in atoms]))
            back = atoms[away] - weights
            if float(weights @ back) > gap - slack and shares[away] < 1.0:
                direction, longest = -back, shares[away] / (1.0 - shares[away])
            else:
                away, direction, longest = -1, target - weights, 1.0
            length = float(direction @ direction)
            move = min(longest, max(0.0, -float(weights @ direction) / length)) if length > 0 else 0.0
            if away < 0:
                shares = [x * (1.0 - move) for x in shares] + [move]
                atoms.append(target)
            else:
                shares = [x * (1.0 + move) for x in shares]
                shares[away] -= move
            kept = [i for i, x in enumerate(shares) if x > 1e-12]
            atoms, shares = [atoms[i] for i in kept], [shares[i] for i in kept]
        raise ArithmeticError(f"the duality gap is still {gap:.3g} after {most} steps")

    @classmethod
    def _lowest(cls, df: DataFrame, projection, phase, weights, zone: tuple[float, float], wanted: float) -> tuple[np.ndarray, float, float, tuple[float, float]]:
        """Mean map of the ``wanted`` rows of lowest score, the score that bounds them, how much lower the mean score
        could be with the rows of the last cell in order, and where to look next.

        Rows below the zone are summed as one, those inside it in cells; a pass whose zone turns out not to hold the
        bound is followed by one over all scores.
        """
        reach = np.sqrt(2.0) * float(np.sqrt(weights @ weights))  # no map is longer than the root of two
        low, high = max(zone[0], -reach), min(zone[1], reach)
        for low, high in ((low, high), (-reach, reach)):
            below, n, cells, counts = cls._sums(df, projection, phase, weights, (low, high))
            held = n + np.cumsum(counts)
            if n <= wanted <= held[-1]:
                break
        at = int(np.searchsorted(held, wanted))
        before = n + (counts[:at].sum() if at else 0)
        part = (wanted - before) / counts[at] if counts[at] else 0.0  # all rows of the last cell weigh alike
        total = below + cells[:at].sum(0) + part * cells[at]
        size = (high - low) / len(counts)
        offset = low + (at + part) * size
        near = (offset - 8 * size, offset + 8 * size) if size > 1e-6 * reach else (low, high)
        return total / wanted, offset, size * counts[at] / wanted, near

    @staticmethod
    def _sums(df: DataFrame, projection, phase, weights, zone: tuple[float, float]):
        """Sum and number of the maps below the zone (all, without weights), and both for each cell of it."""
        dims, (low, high) = len(phase), zone

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros((CELLS + 1, dims)), np.zeros(CELLS + 1, np.int64)
            for b in batches:
                z = np.sqrt(2.0 / dims) * np.cos(_matrix(b["features"], projection.shape[0]) @ projection + phase)
                if weights is None:
                    cell = np.zeros(len(z), np.int64)
                else:
                    cell = np.floor((z @ weights - low) / (high - low) * CELLS).astype(np.int64) + 1
                    z, cell = z[cell <= CELLS], np.maximum(cell[cell <= CELLS], 0)
                order = np.argsort(cell, kind="stable")
                some, first = np.unique(cell[order], return_index=True)
                if len(some):
                    total[some] += np.add.reduceat(z[order], first, 0)
                n += np.bincount(cell, minlength=CELLS + 1)
            for c in np.flatnonzero(n):
                yield pd.DataFrame({"cell": c, "dim": np.arange(dims), "s": total[c], "n": n[c]})

        parts = df.select("features").mapInPandas(sums, "cell int, dim int, s double, n bigint")
        rows = parts.groupBy("cell", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas()  # (CELLS + 1) * dims at most
        total, n = np.zeros((CELLS + 1, dims)), np.zeros(CELLS + 1, np.int64)
        total[rows["cell"], rows["dim"]] = rows["s"]
        n[rows["cell"]] = rows["n"]
        return total[0], int(n[0]), total[1:], n[1:]

    def scorer(self):
        """Column function over ``features``: offset minus score, higher is more anomalous."""
        projection, phase, weights, offset = self.projection, self.phase, self.weights, self.offset

        @F.arrow_udf("double")
        def score(features: pa.Array) -> pa.Array:
            x = matrix_of(features)
            z = np.sqrt(2.0 / len(phase)) * np.cos(x @ projection + phase)
            return pa.array(offset - z @ weights)

        return score


# -- composite ------------------------------------------------------------------------------------


def composite(s_if: Column, s_lof: Column, s_ocsvm: Column) -> Column:
    mixed = WEIGHTS["if"] * s_if + WEIGHTS["lof"] * s_lof + WEIGHTS["ocsvm"] * s_ocsvm
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))


def anomaly_label(score: Column, contamination: float = 0.02) -> Column:
    """An absolute cut at 1 - contamination, not the top share of the batch."""
    return F.coalesce((score >= F.lit(1.0 - contamination)).cast("int"), F.lit(0))


class AnomalyDetector:
    """Fit on (id, feature columns); score adds ``anomaly_score`` and ``is_anomaly``."""

    def __init__(self, contamination: float = 0.02, n_estimators: int = 200, random_state: int = 42):
        self.contamination, self.n_estimators, self.random_state = contamination, n_estimators, random_state
        self.scaler: Scaler | None = None
        self.score_stats: dict[str, tuple[float, float]] = {}

    def _scaled(self, df: DataFrame, id_col: str) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), self.scaler.vector().alias("features"))

    def fit(self, df: DataFrame, columns: list[str], id_col: str = "transaction_id") -> "AnomalyDetector":
        self.scaler = Scaler.fit(df, columns)
        rows = pin(self._scaled(df, id_col))
        n = rows.count()
        self.forest = IsolationForest.fit(rows, self.n_estimators, self.random_state, n)
        self.lof = LocalOutlierFactor.fit(rows, NEIGHBORS, n)
        self.svm = OneClassSvm.fit(rows, len(columns), seed=self.random_state)
        self.score_stats = score_range(self._raw(rows), ["s_if", "s_lof", "s_ocsvm"])
        return self

    def _raw(self, rows: DataFrame) -> DataFrame:
        scored = rows.select(
            "id", self.forest.scorer()("features").alias("s_if"), self.svm.scorer()("features").alias("s_ocsvm")
        )
        return scored.join(self.lof.score(rows), "id")

    def score(self, df: DataFrame, id_col: str = "transaction_id") -> DataFrame:
        """The rows with ``anomaly_score`` in [0, 1] and ``is_anomaly``; ids may be null or repeat."""
        if self.scaler is None:
            raise RuntimeError("The detector has no fitted state yet: call fit first.")
        # Scores come back by a row key of our own, pinned so that it is given once.
        keyed = pin(df.withColumn("_row", F.monotonically_increasing_id()))
        raw = self._raw(self._scaled(keyed, "_row"))
        parts = {n: normalise(F.col(n), *self.score_stats[n]) for n in self.score_stats}
        scores = raw.select(
            F.col("id").alias("_row"), composite(parts["s_if"], parts["s_lof"], parts["s_ocsvm"]).alias("anomaly_score")
        )
        return keyed.join(scores, "_row").drop("_row").withColumn("is_anomaly", anomaly_label(F.col("anomaly_score"), self.contamination))

    # -- fitted state as tables ---------------------------------------------------------------

    def save(self, path: str) -> str:
        spark = self.forest.nodes.sparkSession
        s, m = self.scaler, self.svm
        row = (
            s.columns, s.means, s.deviations, m.projection.ravel().tolist(), m.phase.tolist(), m.weights.tolist(),
            m.offset, self.forest.sample, self.forest.n_trees, self.lof.k, self.contamination, self.random_state,
            {k: list(v) for k, v in self.score_stats.items()},
        )
        schema = (
            "columns array<string>, means array<double>, deviations array<double>, projection array<double>, "
            "phase array<double>, weights array<double>, offset double, sample int, n_trees int, k int, "
            "contamination double, seed int, stats map<string,array<double>>"
        )
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        self.forest.nodes.write.mode("overwrite").parquet(f"{path}/forest")
        self.lof.index.save(f"{path}/lof_index")
        self.lof.density.write.mode("overwrite").parquet(f"{path}/lof_density")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AnomalyDetector":
        r = spark.read.parquet(f"{path}/settings").first()
        out = cls(r["contamination"], r["n_trees"], r["seed"])
        out.scaler = Scaler(list(r["columns"]), list(r["means"]), list(r["deviations"]))
        projection = np.array(r["projection"]).reshape(len(r["columns"]), -1)
        out.svm = OneClassSvm(projection, np.array(r["phase"]), np.array(r["weights"]), r["offset"])
        out.forest = IsolationForest(spark.read.parquet(f"{path}/forest"), r["sample"], r["n_trees"])
        out.lof = LocalOutlierFactor(NeighborIndex.load(spark, f"{path}/lof_index"), spark.read.parquet(f"{path}/lof_density"), r["k"])
        out.score_stats = {k: tuple(v) for k, v in r["stats"].items()}
        return out
