"""Mixing of sources to target weights: iterative proportional fitting, then calibrated sampling.

Tokens are summed to cells of source, language and topic before anything is fitted. Raking scales
the cells to each marginal in turn until all agree. A cell's documents are then kept with a
probability in proportion to its fitted share over its tokens, scaled so that the expected tokens
meet the budget; cells that would need more than all their tokens keep everything and the others
make up for it. Draws are hashes of id and text, so they repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import OWN
from riskloom.session import pin

MARGINS = ("source", "language", "topic")
TEMPERATURE = 0.5  # default targets: shares of tokens raised to this power
BUDGET = 0.5  # expected share of all tokens that is kept
TOLERANCE = 1e-6
ROUNDS = 50
SEED = 17


def n_tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for a null."""
    return F.coalesce(F.size(F.filter(F.split(text.cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))


def surface_topic(text: Column) -> Column:
    """A coarse subject from the form of a text, for tables that carry no topic of their own."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    size = F.greatest(F.length(body), F.lit(1))
    share = lambda marks: (size - F.length(F.translate(body, marks, ""))) / size
    return (
        F.when(F.length(F.trim(body)) == 0, "empty").when(share("|\t") > 0.02, "table").when(share("{}();=<>") > 0.03, "code")
        .when(share("0123456789") > 0.1, "figures").when(size < 500, "note").when(size < 4000, "article").otherwise("long read")
    )


def tempered(cells: DataFrame, margin: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Target shares of the values of one margin: ``value`` and ``share``."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), temperature).alias("raised"))
    return sums.crossJoin(sums.agg(F.sum("raised").alias("all"))).select("value", (F.col("raised") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``weight``: shares of one that meet every target, nearest to those of ``tokens``.

    Stops when every marginal is within ``tolerance`` of its target or after ``rounds``; targets that
    contradict the empty cells cannot be met, and the last round stands. Values without a target keep
    no weight; nulls are a value.
    """
    now = pin(cells.withColumn("weight", F.col("tokens").cast("double")))
    aims = {m: pin(t.select(F.col("value").alias(f"{m}_value"), "share")) for m, t in targets.items()}
    for _ in range(rounds):
        step, gaps = now, []
        for margin, aim in aims.items():
            sums = step.groupBy(F.col(margin).alias("of")).agg(F.sum("weight").alias("sum"))
            scale = sums.join(aim, sums["of"].eqNullSafe(aim[f"{margin}_value"]), "left").select(
                "of", F.when(F.col("sum") > 0, F.coalesce("share", F.lit(0.0)) / F.col("sum")).otherwise(0.0).alias("factor")
            )
            step = step.join(scale, step[margin].eqNullSafe(scale["of"])).withColumn("weight", F.col("weight") * F.col("factor")).drop("of", "factor")
        now = pin(step)
        for margin, aim in aims.items():
            sums = now.groupBy(F.col(margin).alias("of")).agg(F.sum("weight").alias("sum"))
            off = sums.join(aim, sums["of"].eqNullSafe(aim[f"{margin}_value"])).agg(F.max(F.abs(F.col("sum") - F.col("share"))))
            gaps.append(off.first()[0] or 0.0)
        if max(gaps, default=0.0) < tolerance:
            break
    return now


def keep_rates(cells: DataFrame, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``rate``: the probability of keeping a document, so that tokens meet the budget.

    Rates are in proportion to weight over tokens; full cells are set aside and the scale of the rest
    is raised, until no more cells fill. Cells without tokens are kept whole.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted, scale = budget * total, 0.0
    for _ in range(rounds):
        full = F.coalesce(F.lit(scale) * ratio >= 1, F.lit(False))
        taken, left = cells.agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (wanted - taken) / left if left > 0 else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return cells.withColumn("rate", F.coalesce(F.least(F.lit(1.0), F.lit(scale) * ratio), F.lit(1.0)))


def mix(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", language: str = "lang",
    topic: Column | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = SEED,
) -> DataFrame:
    """All columns of ``docs`` with the decision on each row under the prefix ``base.OWN``.

    Added: ``topic``, ``tokens``, ``rate`` (probability of being kept), ``weight`` (tokens that each kept
    token stands for, so that weighted tokens meet the targets in expectation) and ``selected``.
    ``targets`` maps a margin to ``value`` and ``share``; margins left out get tempered shares of their
    tokens. Null sources, languages and texts form values and cells of their own; repeated rows share
    their fate; every row stays, selected or not.
    """
    body = F.col(f"`{text}`")
    names = dict(zip(MARGINS, (f"{OWN}source", f"{OWN}language", f"{OWN}topic")))
    given = docs.withColumns({
        names["source"]: F.col(f"`{source}`").cast("string"), names["language"]: F.col(f"`{language}`").cast("string"),
        names["topic"]: surface_topic(body) if topic is None else topic, f"{OWN}tokens": n_tokens(body).cast("long"),
    })
    cells = pin(given.groupBy(*[F.col(c).alias(m) for m, c in names.items()]).agg(F.sum(f"{OWN}tokens").alias("tokens")))
    aims = {m: (targets or {}).get(m) if m in (targets or {}) else tempered(cells, m) for m in MARGINS}
    rates = pin(keep_rates(rake(cells, aims), budget))
    total = F.lit(float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]))
    stands_for = F.when(F.col("rate") * F.col("tokens") > 0, F.col("weight") * total / (F.col("rate") * F.col("tokens")))
    per = rates.select(*[F.col(m).alias(f"{OWN}{m}_cell") for m in MARGINS], F.col("rate").alias(f"{OWN}rate"), stands_for.alias(f"{OWN}w"))
    on = [F.col(c).eqNullSafe(F.col(f"{OWN}{m}_cell")) for m, c in names.items()]
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), body), F.lit(1 << 52)) / float(1 << 52)
    return given.join(per, on, "left").withColumns({
        f"{OWN}selected": draw < F.col(f"{OWN}rate"), f"{OWN}weight": F.coalesce(f"{OWN}w", F.lit(1.0)),
    }).drop(f"{OWN}w", names["source"], names["language"], *[f"{OWN}{m}_cell" for m in MARGINS])
