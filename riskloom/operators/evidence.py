"""Evidence behind a flagged row: strongest contributions, query text, prompt."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import fixed, signed


def top_contributions(contributions: Column, k: int) -> Column:
    """The k entries of a map<string,double> largest by absolute value (ties by name), as structs."""
    ordered = F.array_sort(
        F.transform(
            F.map_entries(contributions),
            lambda e: F.struct((-F.abs(e["value"])).alias("rank"), e["key"].alias("feature"), e["value"].alias("value")),
        )
    )
    return F.transform(
        F.slice(ordered, 1, k), lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"))
    )


# --- fixed values: texts a reader of the reports expects to the letter ---
EVIDENCE_LINE = "  - {feature}: {value} ({direction} fraud risk)"
QUERY_TEXT = "Transaction amount {amount} in {category} category flagged with fraud score {score}. Key signals: {signals}."
EXCERPT = "[Policy excerpt]\n{text}"
PROMPT = """Transaction details:
{details}

Model scores:
  Fraud probability: {score}
  Anomaly score:     {anomaly}

Top SHAP feature contributions:
{evidence}

Relevant policy context:
{context}

Please explain why this transaction was flagged."""
# --------------------------------------------------------------------------


def fill(template: str, **values: Column) -> Column:
    """The template with each named place taken by a column."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [values[name]] if name else []
    return F.concat(*parts)


def evidence_text(contributions: Column, k: int = 5) -> Column:
    """One line per contribution with its sign and direction."""
    lines = F.transform(
        top_contributions(contributions, k),
        lambda e: fill(
            EVIDENCE_LINE,
            feature=e["feature"],
            value=signed(e["value"]),
            direction=F.when(e["value"] > 0, "increases").otherwise("decreases"),
        ),
    )
    return F.array_join(lines, "\n")


def query_text(amount: Column, category: Column, score: Column, contributions: Column) -> Column:
    """The retrieval query of a flagged row; missing fields read "unknown"."""
    names = F.transform(top_contributions(contributions, 3), lambda e: F.replace(e["feature"], F.lit("_"), F.lit(" ")))
    return fill(
        QUERY_TEXT,
        amount=F.coalesce(amount.cast("string"), F.lit("unknown")),
        category=F.coalesce(category, F.lit("unknown")),
        score=fixed(score, 2),
        signals=F.array_join(names, ", "),
    )


def prompt_text(details: Column, score: Column, anomaly: Column, evidence: Column, excerpts: Column) -> Column:
    """Transaction, scores, evidence and policy excerpts (array of text) in one text."""
    context = F.array_join(F.transform(excerpts, lambda x: fill(EXCERPT, text=x)), "\n\n")
    return fill(PROMPT, details=details, score=fixed(score, 4), anomaly=fixed(anomaly, 4), evidence=evidence, context=context)


def flagged_first(df: DataFrame, threshold: float = 0.5, limit: int = 50, score: str = "fraud_score") -> DataFrame:
    """The most suspicious flagged rows: a top-k report, ties by id."""
    return df.filter(F.col(score) >= threshold).orderBy(F.col(score).desc(), "transaction_id").limit(limit)


def attach_explanations(df: DataFrame, explanations: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Explanation text by transaction id, or by another key that both have; empty where there is none."""
    out = df.join(explanations.select(key, "explanation"), key, "left")
    return out.withColumn("explanation", F.coalesce("explanation", F.lit("")))
