"""Supervised ensemble: two boosted models and a forest, soft vote, calibrated over folds.

The trees of all folds are grown together by ``trees``; the boosted models minimise the logistic loss under two
weightings. They stand in for the usual external boosting libraries and do not reproduce their numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import score_label
from riskloom.operators.contributions import Explainer
from riskloom.operators.neighbors import matrix_of
from riskloom.operators.sampling import smote, synthetic_rows, with_folds
from riskloom.operators.scaling import Scaler
from riskloom.operators.trees import Bins, BoostSpec, ForestSpec, Trees, codes_of, grow_all, logistic, total
from riskloom.session import pin

# --- fixed values: vote weights and training defaults ---
VOTE_WEIGHTS = (0.4, 0.4, 0.2)
BOOST_DEFAULTS = {"rounds": 500, "depth": 6, "step": 0.05, "row_share": 0.8, "column_share": 0.8}
FOREST_DEFAULTS = {"trees": 300, "depth": 12}
POSITIVE_WEIGHT = 50.0

MEMBERS = ("boosted", "boosted_balanced", "forest")
VOTE_DIGITS = 6  # votes that agree so far are one point of the calibration, which bounds what it pools
NODES_COLUMNS = ["fold", "model", "tree", "node", "feature", "cut", "left", "right", "value", "cover"]


def soft_vote(a: Column, b: Column, c: Column, weights: tuple[float, float, float] = VOTE_WEIGHTS) -> Column:
    wa, wb, wc = weights
    return (a * wa + b * wb + c * wc) / (wa + wb + wc)


def balanced_weights(n0: int, n1: int) -> tuple[float, float]:
    """n / (2 n_class): both classes weigh the same in all."""
    return (n0 + n1) / (2.0 * max(n0, 1)), (n0 + n1) / (2.0 * max(n1, 1))


@dataclass
class FraudEnsemble:
    boost_params: dict = field(default_factory=dict)
    balanced_boost_params: dict = field(default_factory=dict)
    forest_params: dict = field(default_factory=dict)
    calibration_method: str = "isotonic"
    random_state: int = 42
    folds: int = 3
    smote_ratio: float = 0.1
    compat: bool = False  # oversample before the folds are cut, as the original order of steps does

    def __post_init__(self):
        if not 1 <= self.folds <= 8:
            raise ValueError("between one and eight folds")  # a row's folds are the bits of a byte
        self.scaler: Scaler | None = None
        self.bins: Bins | None = None
        self.members: list[tuple[Trees, Trees, Trees]] = []  # by fold, in the order of MEMBERS
        self.calibrators: list = []
        self._explainer: Explainer | None = None
        self._sent = None

    # -- training -----------------------------------------------------------------------------

    def fit(self, df: DataFrame, columns: list[str], label: str = "is_fraud", id_col: str = "transaction_id"):
        self.scaler = Scaler.fit(df, columns)
        rows = df.select(
            F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias("label"), self.scaler.vector().alias("features")
        )
        if self.compat:
            rows = smote(pin(rows), ratio=self.smote_ratio, seed=self.random_state)
        rows = pin(with_folds(pin(rows), "label", "id", self.folds, self.random_state))
        self.bins = Bins.fit(rows, len(columns))
        self.members = self._grow(self._learned(rows))
        self._sent = self._explainer = None
        self._fit_calibrators(rows)
        return self

    def _learned(self, rows: DataFrame) -> DataFrame:
        """(id, label, member, features): each row once, with a bit for every fold whose models learn from it."""
        every = (1 << self.folds) - 1
        others = F.lit(every) - F.expr("shiftleft(1, fold)") if self.folds > 1 else F.lit(1)
        out = rows.select("id", "label", others.cast("int").alias("member"), "features")
        if not self.compat:
            for fold in range(self.folds):
                made = synthetic_rows(out.filter(F.col("member").bitwiseAND(1 << fold) > 0), ratio=self.smote_ratio, seed=self.random_state)
                if made is not None:
                    out = out.unionByName(made.withColumn("member", F.lit(1 << fold)))
        return pin(out)

    def _grow(self, learn: DataFrame) -> list[tuple[Trees, Trees, Trees]]:
        counted = learn.groupBy("member", "label").count().collect()  # a row for each set of folds
        of = lambda fold, y: sum(r["count"] for r in counted if r["member"] >> fold & 1 and r["label"] == y)
        boosts, forests = [], []
        for fold in range(self.folds):
            even = balanced_weights(of(fold, 0), of(fold, 1))
            for params, weights, shift in ((self.boost_params, (1.0, POSITIVE_WEIGHT), 0), (self.balanced_boost_params, even, 100)):
                boosts.append(BoostSpec(fold, weights, **{**BOOST_DEFAULTS, **params}, seed=self.random_state + shift + fold))
            forests.append(ForestSpec(fold, even, **{**FOREST_DEFAULTS, **self.forest_params}, seed=self.random_state + fold))
        boosted, forest = grow_all(learn, self.bins, sum(r["count"] for r in counted), boosts, forests)
        return [(boosted[2 * f], boosted[2 * f + 1], forest[f]) for f in range(self.folds)]

    def _shares(self, features: Column) -> Column:
        """Probabilities of all members, fold by fold. The trees are sent whole; their size is bounded by the settings."""
        if self._sent is None:
            packed = [tuple(m.packed() for m in fold) for fold in self.members]
            self._sent = SparkSession.active().sparkContext.broadcast((self.bins.edges, packed, [len(f[2]) for f in self.members]))
        sent = self._sent

        @F.arrow_udf("array<double>")
        def shares(x: pa.Array) -> pa.Array:
            edges, packed, trees = sent.value
            codes = codes_of(edges, matrix_of(x))
            out = []
            for (a, b, c), n in zip(packed, trees):
                out += [logistic(total(m, codes)) for m in (a, b)] + [total(c, codes) / n]
            ends = np.arange(len(codes) + 1, dtype=np.int32) * len(out)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(out, 1).ravel()))

        return shares(features)

    def member_scores(self, df: DataFrame) -> DataFrame:
        """Add a column for each member of each fold, such as ``forest_0``: its probability before vote and calibration."""
        self._check_fitted()
        out = df.withColumn("_shares", self._shares(self.scaler.vector()))
        names = [f"{m}_{f}" for f in range(len(self.members)) for m in MEMBERS]
        return out.withColumns({n: F.get("_shares", F.lit(i)) for i, n in enumerate(names)}).drop("_shares")

    @staticmethod
    def _vote(shares: str, fold: int) -> Column:
        return soft_vote(*[F.get(shares, F.lit(3 * fold + i)) for i in range(3)])

    def _fit_calibrators(self, rows: DataFrame) -> None:
        voted = rows.select("fold", "label", self._shares(F.col("features")).alias("_shares"))
        vote = F.lit(None).cast("double")
        for fold in range(self.folds):
            vote = F.when(F.col("fold") == fold, self._vote("_shares", fold)).otherwise(vote)
        voted = pin(voted.select("fold", "label", vote.alias("vote")))
        self.calibrators = [self._fit_calibrator(voted.filter(F.col("fold") == fold)) for fold in range(self.folds)]

    def _fit_calibrator(self, voted: DataFrame):
        if self.calibration_method == "isotonic":
            counted = voted.groupBy(F.round("vote", VOTE_DIGITS).alias("vote")).agg(
                F.avg(F.col("label").cast("double")).alias("rate"), F.count("*").cast("double").alias("n")
            )
            return IsotonicRegression(featuresCol="vote", labelCol="rate", weightCol="n").fit(counted)
        ready = voted.select(array_to_vector(F.array("vote")).alias("v"), F.col("label").cast("double").alias("label"))
        return LogisticRegression(featuresCol="v", labelCol="label").fit(ready)

    @staticmethod
    def _calibrated(df: DataFrame, calibrator, name: str, vote: str = "vote") -> DataFrame:
        if isinstance(calibrator, IsotonicRegressionModel):
            return calibrator.setFeaturesCol(vote).setPredictionCol(name).transform(df)
        out = calibrator.setFeaturesCol("_v").setProbabilityCol("_q").setRawPredictionCol("").setPredictionCol("").transform(
            df.withColumn("_v", array_to_vector(F.array(vote)))
        )
        return out.withColumn(name, vector_to_array("_q")[1]).drop("_v", "_q")

    # -- scoring ------------------------------------------------------------------------------

    def votes(self, df: DataFrame) -> DataFrame:
        """Add ``vote_0``, ``vote_1``, …: the soft vote of each fold's members."""
        self._check_fitted()
        out = df.withColumn("_shares", self._shares(self.scaler.vector()))
        return out.withColumns({f"vote_{f}": self._vote("_shares", f) for f in range(len(self.members))}).drop("_shares")

    def predict_proba(self, df: DataFrame, name: str = "fraud_score") -> DataFrame:
        """Add the calibrated probability: the mean over the folds' members. No shuffle."""
        out = self.votes(df)
        folds = range(len(self.members))
        for f in folds:
            out = self._calibrated(out, self.calibrators[f], f"_fold{f}", f"vote_{f}")
        mean = sum((F.col(f"_fold{f}") for f in folds[1:]), F.col("_fold0")) / len(folds)
        return out.withColumn(name, mean).drop(*[f"{c}{f}" for f in folds for c in ("_fold", "vote_")])

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict_proba(df).withColumn("fraud_label", score_label(F.col("fraud_score"), threshold))

    def explain(self, df: DataFrame, max_display: int = 10) -> DataFrame:
        """Add ``contributions`` and ``base_value`` from the first fold's first boosted model."""
        self._check_fitted()
        if self._explainer is None:
            self._explainer = Explainer.fit(SparkSession.active(), self.members[0][0], self.bins, self.scaler.columns)
        ready = df.withColumn("features", self.scaler.vector())
        return self._explainer.explain(ready, "features", max_display).drop("features")

    def _check_fitted(self) -> None:
        if not self.members:
            raise RuntimeError("The ensemble has no members yet: call fit first.")

    # -- fitted state -------------------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> str:
        s = self.scaler
        row = (s.columns, s.means, s.deviations, len(self.members), self.calibration_method, [e.tolist() for e in self.bins.edges])
        schema = "columns array<string>, means array<double>, deviations array<double>, folds int, calibration string, edges array<array<double>>"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        nodes = pa.Table.from_batches([
            pa.RecordBatch.from_arrays([pa.array([f] * len(rows), pa.int32()), pa.array([m] * len(rows)), *map(pa.array, zip(*rows))], NODES_COLUMNS)
            for f, fold in enumerate(self.members) for m, trees in zip(MEMBERS, fold) if (rows := trees.rows())
        ])
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/trees")
        for i, calibrator in enumerate(self.calibrators):
            calibrator.write().overwrite().save(f"{path}/calibrator{i}")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FraudEnsemble":
        r = spark.read.parquet(f"{path}/settings").first()
        out = cls(calibration_method=r["calibration"], folds=r["folds"])
        out.scaler = Scaler(list(r["columns"]), list(r["means"]), list(r["deviations"]))
        out.bins = Bins([np.array(e) for e in r["edges"]])
        table = spark.read.parquet(f"{path}/trees").toPandas().sort_values(["fold", "model", "tree", "node"])
        grown = {key: Trees.of(part) for key, part in table.groupby(["fold", "model"])}
        out.members = [tuple(grown[f, m] for m in MEMBERS) for f in range(r["folds"])]
        calibrator = IsotonicRegressionModel if r["calibration"] == "isotonic" else LogisticRegressionModel
        out.calibrators = [calibrator.load(f"{path}/calibrator{i}") for i in range(r["folds"])]
        return out
