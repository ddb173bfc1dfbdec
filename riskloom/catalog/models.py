"""Registered queries: scaling, detectors, sampling, ensemble and explanations.

Forests and boosted models are trained at the full sizes of the library's defaults. One training
run per session and folder serves all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.catalog.base import TXN, scratch, with_sql
from riskloom.operators.anomaly import IsolationForest, LocalOutlierFactor, OneClassSvm, anomaly_label, composite
from riskloom.operators.ensemble import MEMBERS, soft_vote
from riskloom.operators.features import FeatureBuilder
from riskloom.operators.sampling import smote, stratified_split, with_folds
from riskloom.operators.scaling import Scaler, normalise, score_range
from riskloom.plans.scoring import recent_history, responses, score_batch
from riskloom.plans.training import RiskModels, TrainingPlan, TrainingRun
from riskloom.schema import AUGMENTED_COLUMNS
from riskloom.session import pin
from riskloom.sources.transactions import read_transactions
from riskloom.streaming.micro_batch import against_history, run_batches, with_models
from riskloom.streaming.windows import stream_source

COLUMNS = ["amount", "account_age_days", "credit_utilization", "prior_fraud_count", "merchant_id"]
_RUNS: dict[tuple[str, str], TrainingRun] = {}


def training_run(spark: SparkSession, sf: str) -> TrainingRun:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = TrainingPlan().run(read_transactions(spark, sf))
    return _RUNS[key]


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf)
    scaler = Scaler.fit(rows, COLUMNS)
    return rows.select(F.col("transaction_id").alias("id"), "is_fraud", scaler.vector().alias("features"))


def scaling(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf)
    scaler = Scaler.fit(rows, COLUMNS)
    return rows.select("transaction_id", *[F.round(scaler.column(c), 6).alias(c) for c in COLUMNS])


def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    rows = pin(scaled(spark, sf))
    forest = IsolationForest.fit(rows.select("id", "features"))
    return rows.select(F.col("id").alias("transaction_id"), F.round(forest.scorer()("features"), 6).alias("s_if"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features")
    )


def local_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = embeddings(spark, sf).select("id", "features")
    lof = LocalOutlierFactor.fit(rows, k=20)
    return lof.score(rows).select(F.col("id").alias("vec_id"), F.round("s_lof", 6).alias("s_lof"))


LOF_SQL = """WITH d AS (
  SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 65), lambda x:
    (CAST(a.embedding[x] AS DOUBLE) - b.embedding[x]) * (CAST(a.embedding[x] AS DOUBLE) - b.embedding[x])))) AS d
  FROM embeddings a CROSS JOIN embeddings b),
fit AS (SELECT i, j, d FROM d WHERE i <> j QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 20),
kd AS (SELECT i, max(d) AS kdist FROM fit GROUP BY i),
lrd AS (SELECT fit.i, 1 / (avg(greatest(d, kdist)) + 1e-10) AS lrd FROM fit JOIN kd ON kd.i = fit.j GROUP BY fit.i),
near AS (SELECT i, j, d FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 20),
own AS (SELECT near.i, 1 / (avg(greatest(d, kdist)) + 1e-10) AS own FROM near JOIN kd ON kd.i = near.j GROUP BY near.i),
around AS (SELECT near.i, avg(lrd) AS around FROM near JOIN lrd ON lrd.i = near.j GROUP BY near.i)
SELECT i AS vec_id, round(around / own, 6) AS s_lof FROM own JOIN around USING (i)"""


def transaction_outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = pin(scaled(spark, sf)).select("id", "features")
    return LocalOutlierFactor.fit(rows).score(rows).select(F.col("id").alias("transaction_id"), "s_lof")


def outliers_rounded(spark: SparkSession, sf: str) -> DataFrame:
    out = transaction_outliers(spark, sf)
    return out.select("transaction_id", F.round("s_lof", 4).alias("s_lof"))


_GAP = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in COLUMNS)
OUTLIERS_SQL = with_sql(TXN, f""", x AS MATERIALIZED (
  SELECT transaction_id, {", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in COLUMNS)} FROM txn
), near AS MATERIALIZED (
  SELECT a.transaction_id AS i, min({{'d': sqrt({_GAP}), 'j': b.transaction_id}}, 21) AS l FROM x a CROSS JOIN x b GROUP BY 1
), fit AS (SELECT i, list_filter(l, lambda e: e.j <> i)[1:20] AS l FROM near
), kd AS (SELECT i AS j, l[20].d AS kdist FROM fit
), pairs AS (SELECT i, unnest(l, recursive := true) FROM fit
), lrd AS (SELECT i, 1 / (avg(greatest(d, kdist)) + 1e-10) AS lrd FROM pairs JOIN kd USING (j) GROUP BY 1
), seen AS (SELECT i, unnest(l[1:20], recursive := true) FROM near
), own AS (SELECT i, 1 / (avg(greatest(d, kdist)) + 1e-10) AS own FROM seen JOIN kd USING (j) GROUP BY 1
), around AS (SELECT seen.i, avg(lrd) AS around FROM seen JOIN lrd ON lrd.i = seen.j GROUP BY 1)
SELECT i AS transaction_id, round(around / own, 4) AS s_lof FROM own JOIN around USING (i)""")


def one_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = pin(scaled(spark, sf))
    svm = OneClassSvm.fit(rows, len(COLUMNS))
    return rows.select(F.col("id").alias("transaction_id"), svm.scorer()("features").alias("s_ocsvm"))


def _proxies(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf)
    ranges = score_range(rows, ["amount", "credit_utilization", "account_age_days"])
    parts = {n: normalise(F.col(n), *ranges[n]) for n in ranges}
    return rows.select("transaction_id", *[parts[n].alias(f"n_{n}") for n in parts]).withColumn("constant", normalise(F.lit(5.0), 5.0, 5.0))


NORMAL = TXN + """, r AS (SELECT min(amount) AS a0, max(amount) AS a1, min(credit_utilization) AS u0, max(credit_utilization) AS u1,
  min(account_age_days) AS g0, max(account_age_days) AS g1 FROM txn),
n AS (SELECT transaction_id, (amount - a0) / (a1 - a0) AS n_amount, (credit_utilization - u0) / (u1 - u0) AS n_credit_utilization,
  CAST(account_age_days - g0 AS DOUBLE) / (g1 - g0) AS n_account_age_days FROM txn CROSS JOIN r)"""


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    p = _proxies(spark, sf)
    return p.select("transaction_id", *[F.round(c, 6).alias(c) for c in p.columns[1:]])


def composite_score(spark: SparkSession, sf: str) -> DataFrame:
    p = _proxies(spark, sf)
    mixed = composite(F.col("n_amount"), F.col("n_credit_utilization"), F.col("n_account_age_days"))
    out = p.select("transaction_id", F.round(mixed, 6).alias("anomaly_score"))
    return out.withColumn("is_anomaly", anomaly_label(F.col("anomaly_score"), 0.4))


def clean_fit(spark: SparkSession, sf: str) -> DataFrame:
    clean = read_transactions(spark, sf).filter(F.col("is_fraud") == 0)
    s = Scaler.fit(clean, COLUMNS)
    rows = list(zip(s.columns, s.means, s.deviations))
    out = spark.createDataFrame(rows, "column string, mean double, deviation double")
    return out.select("column", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def split_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf).select("transaction_id", "is_fraud")
    return stratified_split(rows, "is_fraud").select("transaction_id", "is_fraud", "part")


def fold_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf).select("transaction_id", "is_fraud")
    return with_folds(rows, "is_fraud").select("transaction_id", "fold")


_PLACED = """, placed AS (SELECT transaction_id, is_fraud,
  row_number() OVER (PARTITION BY is_fraud ORDER BY md5(concat(transaction_id, ':42')), transaction_id) AS place,
  count(*) OVER (PARTITION BY is_fraud) AS n FROM txn)"""


def oversampled(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaled(spark, sf).withColumnRenamed("is_fraud", "label")
    return smote(pin(rows))


def oversampled_counts(spark: SparkSession, sf: str) -> DataFrame:
    return oversampled(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def oversampled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic rows with their vectors rounded."""
    out = oversampled(spark, sf).filter(F.col("id").contains("#"))
    return out.select("id", F.transform("features", lambda x: F.round(x, 6)).cast("string").alias("features"))


def votes(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_transactions(spark, sf)
    a, b, c = F.col("credit_utilization"), F.least(F.lit(1.0), F.col("amount") / 300), F.col("account_age_days") / 3650
    return rows.select("transaction_id", F.round(soft_vote(a, b, c), 6).alias("vote"))


def member_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every fold's two boosted models and forest over all rows, before vote and calibration."""
    run = training_run(spark, sf)
    e = run.models.ensemble
    out = e.member_scores(run.train.unionByName(run.validation))
    names = [f"{m}_{f}" for f in range(len(e.members)) for m in MEMBERS]
    return out.select("transaction_id", *[F.round(n, 6).alias(n) for n in names])


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    from riskloom.functions.scalars import risk_tier

    run = training_run(spark, sf)
    both = run.train.unionByName(run.validation)
    return responses(both.withColumn("risk_tier", risk_tier(F.col("fraud_score"))))


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    run = training_run(spark, sf)
    out = run.models.ensemble.explain(run.train.unionByName(run.validation))
    return out.select("transaction_id", F.round("base_value", 6).alias("base_value"), F.explode("contributions").alias("feature", "value"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return training_run(spark, sf).metrics.withColumn("value", F.round("value", 6))


def augmented(spark: SparkSession, sf: str) -> DataFrame:
    run = training_run(spark, sf)
    return run.train.unionByName(run.validation).select("transaction_id", *AUGMENTED_COLUMNS)


def saved_models(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all rows by models that went to storage and back."""
    run = training_run(spark, sf)
    both = run.train.unionByName(run.validation)
    path = run.models.save(spark, scratch(spark, "models"))
    loaded = RiskModels.load(spark, path)
    again = loaded.ensemble.predict_proba(both.drop("fraud_score", "fraud_label"))
    before = both.select("transaction_id", F.col("fraud_score").alias("before"))
    return again.join(before, "transaction_id").select(
        "transaction_id", (F.abs(F.col("fraud_score") - F.col("before")) < 1e-12).cast("int").alias("same")
    )


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    run = training_run(spark, sf)
    return run.train.unionByName(run.validation)


def label_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Every transaction has one score, a share, and the label that the score says."""
    score = F.col("fraud_score")
    kept = score.between(0.0, 1.0) & (F.col("fraud_label") == (score >= 0.5).cast("int")) & F.col("anomaly_score").between(0.0, 1.0)
    return scored_rows(spark, sf).select("transaction_id", kept.cast("int").alias("holds"))


def additive_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Contributions and base value add up to the log-odds of the explained model on every row."""
    e = training_run(spark, sf).models.ensemble
    out = e.explain(e.member_scores(scored_rows(spark, sf)), max_display=len(AUGMENTED_COLUMNS))
    total = F.aggregate(F.map_values("contributions"), F.col("base_value"), lambda a, x: a + x)
    return out.select("transaction_id", (F.abs(1 / (1 + F.exp(-total)) - F.col("boosted_0")) < 1e-9).cast("int").alias("holds"))


def metrics_again(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of the run against those of windows over all scores at once."""
    run = training_run(spark, sf)
    told = {r["metric"]: r["value"] for r in run.metrics.collect()}
    out = []
    for part, rows in (("train", run.train), ("val", run.validation)):
        by = rows.groupBy("fraud_score").agg(F.sum("is_fraud").alias("pos"), F.count("*").alias("n"))
        up, down = Window.orderBy("fraud_score"), Window.orderBy(F.col("fraud_score").desc())
        by = by.withColumns({"neg": F.col("n") - F.col("pos"), "below": F.sum(F.col("n") - F.col("pos")).over(up), "tp": F.sum("pos").over(down), "seen": F.sum("n").over(down)})
        pairs = F.sum("pos").cast("double") * F.sum("neg")
        auc = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)) / pairs
        ap = F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")
        for name, value in (("auc_roc", auc), ("avg_precision", ap)):
            gap = F.abs(value - F.lit(told[f"{part}_{name}"])) < 1e-9
            out.append(by.agg(gap.cast("int").alias("holds")).select(F.lit(f"{part}_{name}").alias("metric"), "holds"))
    return reduce(DataFrame.unionByName, out)


def streamed_models(spark: SparkSession, sf: str) -> DataFrame:
    """The last days scored by the models as a stream of batches, each against all before it, and again as tables."""
    run, rows = training_run(spark, sf), read_transactions(spark, sf)
    source, path, store, state = (scratch(spark, f"models-{n}") for n in ("source", "out", "store", "state"))
    days = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-22", "2024-01-26", "9999-01-01")]
    handle = against_history(with_models(run.models), path, store, rows.filter(F.col("ts") < days[0]))
    again = []
    for first, last in zip(days, days[1:]):
        batch = rows.filter((F.col("ts") >= first) & (F.col("ts") < last))
        batch.write.mode("append").parquet(source)
        run_batches(stream_source(spark, source, rows.schema), handle, state, available_now=True).awaitTermination()
        again.append(responses(score_batch(run.models, batch, recent_history(rows.filter(F.col("ts") < first), batch))))
    told = spark.read.parquet(path).select("transaction_id", F.col("fraud_score").alias("streamed"))
    both = reduce(DataFrame.unionByName, again).join(told, "transaction_id", "full")
    same = F.coalesce(F.abs(F.col("fraud_score") - F.col("streamed")) < 2e-6, F.lit(False))
    return both.select("transaction_id", same.cast("int").alias("holds"))


def fit_then_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics learned on the first half of the month, applied to the second."""
    rows = read_transactions(spark, sf).select("transaction_id", "ts", "amount", "merchant_category")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    model = FeatureBuilder().fit(rows.filter(F.col("ts") < cut))
    out = model.transform(rows.filter(F.col("ts") >= cut))
    return out.select(
        "transaction_id", F.round("amount_zscore", 6).alias("amount_zscore"), "amount_above_p95", "amount_above_p99",
        F.round("merchant_category_freq", 6).alias("merchant_category_freq"),
    )


QUERIES = {
    "g01_standard_scaling": (
        scaling,
        with_sql(TXN, "SELECT transaction_id, " + ", ".join(
            f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in COLUMNS) + " FROM txn"),
    ),
    "g02_isolation_forest": (isolation_forest, None),
    "g03_local_outlier_factor": (local_outliers, LOF_SQL),
    "g03_transaction_outliers": (transaction_outliers, None),
    "g03_outliers_rounded": (outliers_rounded, OUTLIERS_SQL),
    "g04_one_class": (one_class, None),
    "g05_fixed_range": (
        normalised,
        with_sql(NORMAL, """SELECT transaction_id, round(n_amount, 6) AS n_amount, round(n_credit_utilization, 6) AS n_credit_utilization,
  round(n_account_age_days, 6) AS n_account_age_days, CAST(0 AS DOUBLE) AS constant FROM n"""),
    ),
    "g06_g07_composite": (
        composite_score,
        with_sql(NORMAL, """, c AS (SELECT transaction_id, round(greatest(0, least(1, CAST(0.5 AS DOUBLE) * n_amount
  + CAST(0.3 AS DOUBLE) * n_credit_utilization + CAST(0.2 AS DOUBLE) * n_account_age_days)), 6) AS anomaly_score FROM n)
SELECT transaction_id, anomaly_score, CAST(anomaly_score >= CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE) AS INT) AS is_anomaly FROM c"""),
    ),
    "g08_clean_fit": (
        clean_fit,
        with_sql(TXN, "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation FROM txn WHERE is_fraud = 0""" for c in COLUMNS)),
    ),
    "g09_stratified_split": (
        split_parts,
        with_sql(TXN + _PLACED, "SELECT transaction_id, is_fraud, CASE WHEN place <= floor(n * CAST(0.2 AS DOUBLE) + 0.5) THEN 'val' ELSE 'train' END AS part FROM placed"),
    ),
    "g10_oversampled_counts": (
        oversampled_counts,
        with_sql(TXN, """, c AS (SELECT count(*) FILTER (is_fraud = 0) AS n0, count(*) FILTER (is_fraud = 1) AS n1 FROM txn)
SELECT CAST(0 AS INT) AS label, n0 AS n, n0 AS ids FROM c
UNION ALL SELECT CAST(1 AS INT), CAST(greatest(n1, floor(n0 * CAST(0.1 AS DOUBLE))) AS BIGINT), CAST(greatest(n1, floor(n0 * CAST(0.1 AS DOUBLE))) AS BIGINT) FROM c"""),
    ),
    "g10_oversampled_rows": (oversampled_rows, None),
    "g11_g12_g13_member_scores": (member_scores, None),
    "g14_soft_vote": (
        votes,
        with_sql(TXN, """SELECT transaction_id, round((credit_utilization * CAST(0.4 AS DOUBLE) + least(CAST(1 AS DOUBLE), amount / CAST(300 AS DOUBLE)) * CAST(0.4 AS DOUBLE)
  + account_age_days / CAST(3650 AS DOUBLE) * CAST(0.2 AS DOUBLE)) / CAST(1 AS DOUBLE), 6) AS vote FROM txn"""),
    ),
    "g15_folds": (fold_parts, with_sql(TXN + _PLACED, "SELECT transaction_id, CAST(place % 3 AS INT) AS fold FROM placed")),
    "g16_predictions": (predictions, None),
    "g16_label_rule": (label_rule, with_sql(TXN, "SELECT transaction_id, CAST(1 AS INT) AS holds FROM txn")),
    "g17_contributions": (contributions, None),
    "g17_additivity": (additive_contributions, with_sql(TXN, "SELECT transaction_id, CAST(1 AS INT) AS holds FROM txn")),
    "g18_metrics_again": (
        metrics_again,
        "SELECT metric, CAST(1 AS INT) AS holds FROM (VALUES ('train_auc_roc'), ('train_avg_precision'), ('val_auc_roc'), ('val_avg_precision')) AS m(metric)",
    ),
    "j02_streamed_models": (streamed_models, with_sql(TXN, "SELECT transaction_id, CAST(1 AS INT) AS holds FROM txn WHERE ts >= TIMESTAMP '2024-01-22'")),
    "g18_metrics": (metrics, None),
    "g19_e04_augmented_features": (augmented, None),
    "g20_fit_then_transform": (
        fit_then_transform,
        with_sql(TXN, """, old AS (SELECT * FROM txn WHERE ts < TIMESTAMP '2024-01-16'),
s AS (SELECT avg(amount) AS mean, stddev_samp(amount) + 1e-9 AS std, quantile_cont(amount, 0.95) AS p95, quantile_cont(amount, 0.99) AS p99 FROM old),
f AS (SELECT merchant_category, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM old) AS freq FROM old GROUP BY 1)
SELECT transaction_id, round((amount - mean) / std, 6) AS amount_zscore, CAST(amount > p95 AS INT) AS amount_above_p95,
  CAST(amount > p99 AS INT) AS amount_above_p99, round(coalesce(freq, 0), 6) AS merchant_category_freq
FROM txn CROSS JOIN s LEFT JOIN f USING (merchant_category) WHERE ts >= TIMESTAMP '2024-01-16'"""),
    ),
    "a10_saved_models": (saved_models, with_sql(TXN, "SELECT transaction_id, CAST(1 AS INT) AS same FROM txn")),
}
