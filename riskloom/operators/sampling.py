"""Stratified splits and minority oversampling; every random choice is a hash of the row id.

So the outcome does not depend on how rows are partitioned, nor on a task being run twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ordering import ordered_totals
from riskloom.operators.neighbors import knn_join


def hashed_places(df: DataFrame, id_col: str, by: list[str], seed: int) -> DataFrame:
    """(id, place, place_all): rank of each row of a stratum in md5 order, and the stratum's size."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    keys = df.select(id_col, *by, digest.alias("_digest"), F.lit(1).alias("_one"))
    placed = ordered_totals(keys, by, ["_digest", id_col], {"place": "_one"}, with_totals=True)
    return placed.select(id_col, "place", "place_all")


def stratified_split(
    df: DataFrame, label: str, id_col: str = "transaction_id", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part`` (train or val); each class gives the same share, rounded, to val."""
    cut = F.floor(F.col("place_all") * F.lit(test_share) + F.lit(0.5))
    parts = hashed_places(df, id_col, [label], seed).select(
        id_col, F.when(F.col("place") <= cut, "val").otherwise("train").alias("part")
    )
    return df.join(parts, id_col)


def with_folds(df: DataFrame, label: str, id_col: str = "transaction_id", folds: int = 3, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..folds-1, each class spread evenly."""
    places = hashed_places(df, id_col, [label], seed)
    return df.join(places.select(id_col, (F.col("place") % folds).cast("int").alias("fold")), id_col)


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def smote(
    df: DataFrame,
    label: str = "label",
    id_col: str = "id",
    vec_col: str = "features",
    ratio: float = 0.1,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Rows plus synthetic minority rows up to floor(ratio * majority) of them."""
    base = df.select(F.col(id_col).cast("string").alias(id_col), label, vec_col)
    made = synthetic_rows(df, label, id_col, vec_col, ratio, k, seed)
    return base if made is None else base.unionByName(made)


def synthetic_rows(
    df: DataFrame, label: str = "label", id_col: str = "id", vec_col: str = "features", ratio: float = 0.1, k: int = 5, seed: int = 42
) -> DataFrame | None:
    """The rows that ``smote`` adds; None if there are enough.

    Every synthetic row lies between a minority row and one of its k nearest minority rows.
    Copies are dealt out evenly, the remainder by hash order, so the count is exact.
    """
    n0, n1 = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    need = int(ratio * n0) - n1
    if need <= 0:
        return None
    if n1 < 2:
        raise ValueError("oversampling needs at least two minority rows")
    k = min(k, n1 - 1)
    minority = df.select(F.col(id_col).cast("string").alias(id_col), label, vec_col).filter(F.col(label) == 1)
    near = knn_join(minority, minority, k, id_col, vec_col, exclude_self=True)
    dealt = hashed_places(minority, id_col, [], seed).select(
        id_col, (F.lit(need // n1) + (F.col("place") <= need % n1).cast("int")).alias("_copies")
    )
    wanted = (
        minority.join(dealt, id_col)
        .filter(F.col("_copies") > 0)
        .select(id_col, F.col(vec_col).alias("_x"), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_c"))
        .withColumns(
            {
                "_rank": F.pmod(F.xxhash64(id_col, "_c", F.lit(seed)), F.lit(k)) + 1,
                "_u": unit_hash(F.col(id_col), F.col("_c"), F.lit(seed + 1)),
            }
        )
    )
    near = near.select(F.col("query_id").alias(id_col), F.col("rank").alias("_rank"), F.col("neighbor_id").alias("_nid"))
    ends = minority.select(F.col(id_col).alias("_nid"), F.col(vec_col).alias("_y"))
    made = wanted.join(near, [id_col, "_rank"]).join(ends, "_nid")
    return made.select(
        F.concat(F.col(id_col), F.lit("#"), F.col("_c").cast("string")).alias(id_col),
        F.lit(1).cast(df.schema[label].dataType).alias(label),
        F.zip_with("_x", "_y", lambda x, y: x + F.col("_u") * (y - x)).alias(vec_col),
    )
