"""Scoring a batch: features against history, anomaly and fraud scores, tiers, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import align_to_contract, risk_tier, score_label
from riskloom.operators.evidence import attach_explanations, evidence_text, flagged_first, prompt_text, query_text
from riskloom.operators.retrieval import Retriever
from riskloom.plans.training import RiskModels
from riskloom.schema import FEATURE_COLUMNS
from riskloom.session import pin


# A row key of our own: ids of requests may be null and may repeat.
ROW = "_request_row"


def assign_ids(df: DataFrame) -> DataFrame:
    """Requests without an id get one; pinned, because a rerun would draw another."""
    return pin(df.withColumn("transaction_id", F.coalesce(F.col("transaction_id"), F.uuid())))


def with_row_keys(df: DataFrame) -> DataFrame:
    """The rows under ``ROW``, pinned so that each key is given once; ids are filled where they are null."""
    return df if ROW in df.columns else assign_ids(df.withColumn(ROW, F.monotonically_increasing_id()))


def recent_history(history: DataFrame, batch: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the batch's users that a trailing window of ``days`` could still reach.

    The time bound is two literals, so it prunes files and row groups of the history.
    """
    low, high = batch.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return history.limit(0)
    bounded = history.filter(
        (F.col("ts") >= F.lit(low).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY"))
        & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))
    )
    return bounded.join(batch.select("user_id").distinct(), "user_id", "left_semi")


def score_batch(
    models: RiskModels,
    batch: DataFrame,
    history: DataFrame | None = None,
    threshold: float = 0.5,
    tier_bounds: dict[str, float] | None = None,
) -> DataFrame:
    """Contract features plus anomaly_score, is_anomaly, fraud_score, fraud_label and risk_tier.

    ``history`` must not hold rows of the batch. Every row is scored, ids may be null or repeat: rows without an id
    get one, and ``ROW`` tells rows apart.
    """
    batch = with_row_keys(batch)
    featured = models.features.transform(batch, history)
    matrix = pin(align_to_contract(featured, FEATURE_COLUMNS, [ROW, "transaction_id"]))
    scored = models.ensemble.predict_proba(models.detector.score(matrix))
    return scored.withColumns(
        {
            "fraud_label": score_label(F.col("fraud_score"), threshold),
            "risk_tier": risk_tier(F.col("fraud_score"), tier_bounds),
        }
    )


def responses(scored: DataFrame) -> DataFrame:
    """What a caller gets back: scores to six digits, label, tier, explanation."""
    explanation = F.col("explanation") if "explanation" in scored.columns else F.lit("")
    return scored.select(
        "transaction_id",
        F.round("fraud_score", 6).alias("fraud_score"),
        F.round("anomaly_score", 6).alias("anomaly_score"),
        "fraud_label",
        "risk_tier",
        explanation.alias("explanation"),
    )


def explain_flagged(
    models: RiskModels, scored: DataFrame, transactions: DataFrame, retriever: Retriever | None = None, limit: int | None = None
) -> DataFrame:
    """(transaction_id, contributions, evidence, query, explanation) of flagged rows, and ``ROW`` where both tables have it.

    Rows whose ``explain`` is true are explained whatever their score. ``limit`` makes the flagged ones
    a top-k report; None, the default, explains every one.
    """
    asked = F.coalesce(F.col("explain"), F.lit(False)) if "explain" in scored.columns else F.lit(False)
    flagged = scored.filter((F.col("fraud_score") >= 0.5) | asked)
    if limit is not None:
        flagged = flagged_first(scored.filter(~asked), limit=limit).unionByName(scored.filter(asked))
    flagged = pin(flagged)
    key = ROW if ROW in scored.columns and ROW in transactions.columns else "transaction_id"
    ids = list(dict.fromkeys([key, "transaction_id"]))
    with_why = models.ensemble.explain(flagged).select(*ids, "fraud_score", "anomaly_score", "contributions")
    given = [c for c in transactions.columns if c != ROW]
    details = transactions.select(key, "merchant_category", "amount", F.struct(*given).alias("_txn"))
    rows = with_why.join(details, key).withColumns(
        {
            "evidence": evidence_text(F.col("contributions")),
            "query": query_text(F.col("amount"), F.col("merchant_category"), F.col("fraud_score"), F.col("contributions")),
        }
    )
    rows = pin(rows)
    if retriever is not None:
        found = retriever.retrieve(rows, key, "query")
        texts = found.groupBy(F.col("query_id").alias(key)).agg(
            F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_e")  # top_k entries per row
        )
        rows = rows.join(texts, key, "left")
        excerpts = F.coalesce(F.transform("_e", lambda e: e["text"]), F.array().cast("array<string>"))
    else:
        excerpts = F.array().cast("array<string>")
    prompt = prompt_text(F.to_json("_txn", {"pretty": "true"}), F.col("fraud_score"), F.col("anomaly_score"), F.col("evidence"), excerpts)
    return rows.select(*ids, "contributions", "evidence", "query", prompt.alias("explanation"))


def score_and_explain(
    models: RiskModels, batch: DataFrame, history: DataFrame | None = None, retriever=None, limit: int | None = None
) -> DataFrame:
    """Responses with the explanation text of the flagged rows and of those that ask for one, empty elsewhere."""
    batch = with_row_keys(batch)
    scored = score_batch(models, batch, history)
    if "explain" in batch.columns and "explain" not in scored.columns:
        scored = scored.join(batch.select(ROW, "explain"), ROW, "left")
    scored = pin(scored)
    why = explain_flagged(models, scored, batch, retriever, limit)
    return responses(attach_explanations(scored, why, ROW))
