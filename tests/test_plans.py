"""Training and scoring end to end on the small tables."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.ensemble import FraudEnsemble
from riskloom.operators.retrieval import HashedEncoder, Retriever
from riskloom.plans.scoring import explain_flagged, recent_history, score_and_explain, score_batch
from riskloom.plans.training import RiskModels, TrainingPlan
from riskloom.sources.transactions import read_transactions


@pytest.fixture(scope="module")
def run(spark, small, tmp_path_factory):
    ensemble = FraudEnsemble({"rounds": 2, "depth": 3}, {"rounds": 2, "depth": 3}, {"trees": 4, "depth": 4}, folds=2)
    path = str(tmp_path_factory.mktemp("reference") / "table")
    return TrainingPlan(n_estimators=10, ensemble=ensemble).run(read_transactions(spark, small), path), path


def test_training_run(spark, run):
    result, path = run
    values = {r["metric"]: r["value"] for r in result.metrics.collect()}
    assert set(values) == {"train_auc_roc", "train_avg_precision", "val_auc_roc", "val_avg_precision"}
    assert values["val_auc_roc"] > 0.8
    assert spark.read.parquet(path).count() == result.validation.count() == 200


def test_scoring_with_history_and_reload(spark, small, run, tmp_path):
    models = run[0].models
    rows = read_transactions(spark, small)
    cut = F.lit("2024-01-25").cast("timestamp_ntz")
    batch, history = rows.filter(F.col("ts") >= cut), rows.filter(F.col("ts") < cut)
    scored = score_batch(models, batch, recent_history(history, batch))
    assert scored.count() == batch.count()
    assert scored.filter(F.col("txn_count_30d") == 0).count() < batch.count() / 2
    assert scored.filter(~F.col("fraud_score").between(0, 1) | ~F.col("anomaly_score").between(0, 1)).count() == 0
    loaded = RiskModels.load(spark, models.save(spark, str(tmp_path / "models")))
    again = score_batch(loaded, batch, history).select("transaction_id", F.col("fraud_score").alias("again"))
    assert scored.join(again, "transaction_id").filter("abs(fraud_score - again) > 1e-12").count() == 0


def test_explanations(spark, small, run):
    models = run[0].models
    rows = read_transactions(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    retriever = Retriever(HashedEncoder(64)).build(docs)
    out = score_and_explain(models, rows, retriever=retriever).cache()
    flagged = out.filter(F.col("fraud_score") >= 0.5).count()
    assert out.count() == rows.count()
    assert 0 < out.filter("explanation != ''").count() == flagged
    text = out.filter("explanation != ''").first()["explanation"]
    assert text.count("[Policy excerpt]") == 3 and "Top SHAP feature contributions:\n  - " in text


def test_explain_without_limit(spark, small, run):
    models = run[0].models
    rows = read_transactions(spark, small)
    scored = score_batch(models, rows)
    out = explain_flagged(models, scored, rows, limit=None)
    assert out.count() == scored.filter(F.col("fraud_score") >= 0.5).count()


def test_rows_without_or_with_repeated_ids(spark, small, run):
    models = run[0].models
    rows = read_transactions(spark, small).limit(40)
    ids = F.when(F.col("transaction_id").endswith("1"), None).when(F.col("transaction_id").endswith("2"), "same").otherwise(F.col("transaction_id"))
    odd = rows.withColumn("transaction_id", ids).withColumn("explain", F.lit(True))
    out = score_and_explain(models, odd).collect()
    assert len(out) == 40 and all(r["transaction_id"] and r["explanation"] for r in out)
    assert sum(r["transaction_id"] == "same" for r in out) == odd.filter("transaction_id = 'same'").count() > 1
    plain = {r["transaction_id"]: r["fraud_score"] for r in score_batch(models, rows).collect()}
    again = {r["transaction_id"]: r["fraud_score"] for r in out}
    assert all(abs(again[i] - plain[i]) < 1e-6 for i in again if i in plain)


def test_models_score_a_stream(spark, small, run, tmp_path):
    from riskloom.plans.scoring import responses
    from riskloom.streaming.micro_batch import against_history, run_batches, with_models
    from riskloom.streaming.windows import stream_source

    models, rows = run[0].models, read_transactions(spark, small)
    cut = F.lit("2024-01-25").cast("timestamp_ntz")
    past, new = rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut)
    source, path = str(tmp_path / "source"), str(tmp_path / "out")
    new.write.parquet(source)
    handle = against_history(with_models(models, explain=True), path, str(tmp_path / "store"), past)
    run_batches(stream_source(spark, source, rows.schema), handle, str(tmp_path / "state"), available_now=True).awaitTermination()
    got = {r["transaction_id"]: r for r in spark.read.parquet(path).collect()}
    want = responses(score_batch(models, new, recent_history(past, new))).collect()
    assert len(got) == len(want) and all(abs(got[r["transaction_id"]]["fraud_score"] - r["fraud_score"]) < 1e-6 for r in want)
    assert all((r["explanation"] != "") == (r["fraud_label"] == 1) for r in got.values())
