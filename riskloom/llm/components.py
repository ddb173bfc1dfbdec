"""Connected components of a graph given as edges of two long columns, by star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import map_arrow
from riskloom.session import pin


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Edges of one batch, each replaced by an edge to the smallest node it reaches in the batch."""
    for batch in batches:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
        pairs = np.array([(x, top(x)) for x in above if top(x) != x], np.int64).reshape(-1, 2)
        yield {"a": pairs[:, 0], "b": pairs[:, 1]}


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for each node that is not its own root.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and loops do not matter, edges with
    a null are dropped. Large and small stars alternate until nothing moves, so the number of rounds
    grows with the logarithm of the longest chain. Stars are joins and minima, so a node with very
    many neighbours is pre-aggregated and its join partition can be split.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    now = pin(map_arrow(pairs, _forest, "a bigint, b bigint").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # The smallest node of a large star points to itself and drops out; every other keeps one edge.
        large = map_arrow(large.where("a > b"), _forest, "a bigint, b bigint").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.*").where("a > b").distinct()
        now = pin(small)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
