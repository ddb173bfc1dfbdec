"""Training: features, split, anomaly detectors on clean rows, ensemble, metrics, drift baseline."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import align_to_contract
from riskloom.operators.anomaly import AnomalyDetector
from riskloom.operators.drift import set_reference
from riskloom.operators.ensemble import FraudEnsemble
from riskloom.operators.features import FeatureBuilder, FeatureModel
from riskloom.operators.metrics import ranking_metrics
from riskloom.operators.sampling import stratified_split
from riskloom.schema import AUGMENTED_COLUMNS, FEATURE_COLUMNS
from riskloom.session import pin


@dataclass
class RiskModels:
    features: FeatureModel
    detector: AnomalyDetector
    ensemble: FraudEnsemble

    def save(self, spark: SparkSession, path: str) -> str:
        self.features.save(f"{path}/features")
        self.detector.save(f"{path}/detector")
        self.ensemble.save(spark, f"{path}/ensemble")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RiskModels":
        return cls(
            FeatureModel.load(spark, f"{path}/features"),
            AnomalyDetector.load(spark, f"{path}/detector"),
            FraudEnsemble.load(spark, f"{path}/ensemble"),
        )


@dataclass
class TrainingRun:
    models: RiskModels
    train: DataFrame
    validation: DataFrame
    metrics: DataFrame


@dataclass
class TrainingPlan:
    test_share: float = 0.2
    contamination: float = 0.02
    n_estimators: int = 200
    random_state: int = 42
    builder: FeatureBuilder = field(default_factory=FeatureBuilder)
    ensemble: FraudEnsemble = field(default_factory=FraudEnsemble)
    # True learns feature statistics from all rows, validation rows included.
    compat: bool = False

    def run(self, df: DataFrame, reference_path: str | None = None) -> TrainingRun:
        """``df``: labelled transactions with unique ids. Wide intermediate tables are pinned once each."""
        parted = stratified_split(df, "is_fraud", "transaction_id", self.test_share, self.random_state)
        parted = pin(parted)
        known = parted if self.compat else parted.filter(F.col("part") == "train")
        feature_model = self.builder.fit(known)
        matrix = pin(align_to_contract(feature_model.transform(parted), FEATURE_COLUMNS, ["transaction_id", "is_fraud", "part"]))
        detector = AnomalyDetector(self.contamination, self.n_estimators, self.random_state)
        detector.fit(matrix.filter((F.col("part") == "train") & (F.col("is_fraud") == 0)), FEATURE_COLUMNS)
        augmented = pin(detector.score(matrix))
        train = augmented.filter(F.col("part") == "train")
        self.ensemble.fit(train, AUGMENTED_COLUMNS)
        scored = pin(self.ensemble.predict(augmented))
        train, validation = scored.filter(F.col("part") == "train"), scored.filter(F.col("part") == "val")
        metrics = ranking_metrics(train, "is_fraud", "fraud_score", "train").unionByName(
            ranking_metrics(validation, "is_fraud", "fraud_score", "val")
        )
        if reference_path:
            set_reference(validation.drop("part"), reference_path)
        return TrainingRun(RiskModels(feature_model, detector, self.ensemble), train, validation, metrics)
