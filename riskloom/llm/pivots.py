"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points, nearest first. Inverted lists hold the
vectors of every choice of ``SHARED`` of those points, so two vectors meet in a list exactly when
their descriptions share that many; the pair is verified in the list of its smallest shared points
alone, and so counted once. Long lists are cut into blocks that meet pairwise. Only counts and
a spanning set of links leave a task, never all pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import OWN, map_arrow
from riskloom.llm.components import components
from riskloom.session import pin

PIVOTS = 128  # reference points of up to PIVOTS_FOR vectors; they grow with the cube root of the number beyond it
PIVOTS_FOR = 1 << 20
PIVOTS_MOST = 1024
PREFIX = 6  # nearest reference points that describe a vector
SHARED = 3  # of them that two vectors must share to be compared
SAMPLE = 16  # distinct vectors for each reference point from which they are taken
APART = 0.6  # cosine above which two reference points are too alike
LIST_BLOCK = 1024  # vectors of a list compared with each other in one task


def _unit(column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(n, -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def pivot_count(n: int) -> int:
    """Enough reference points that the inverted lists of ``n`` vectors keep their length."""
    return min(PIVOTS_MOST, max(PIVOTS, round(PIVOTS * (n / PIVOTS_FOR) ** (1 / 3))))


def choose_pivots(classes: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` reference points from the ``SAMPLE * most`` vectors of smallest hash, none too alike."""
    sample = classes.orderBy("node").limit(SAMPLE * most).select("v").toArrow().column("v").combine_chunks()
    rows = _unit(sample) if len(sample) else np.zeros((0, 1))
    kept: list[np.ndarray] = []
    for row in rows:
        if len(kept) < most and (not kept or (np.array(kept) @ row).max() < APART):
            kept.append(row)
    return np.array(kept)


def _describe(pivots: np.ndarray):
    take = min(PREFIX, len(pivots))
    share = min(SHARED, take)
    base = 1 + len(pivots)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _unit(batch.column("v")) @ pivots.T
            cell = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :take], axis=1)
            lists = np.zeros((len(cell), 0), np.int64)
            for combo in combinations(range(take), share):
                key = np.zeros(len(cell), np.int64)
                for i in combo:
                    key = key * base + cell[:, i] + 1
                lists = np.column_stack([lists, key])
            yield {n: batch.column(n) for n in batch.schema.names} | {"cell": cell.tolist(), "lists": lists.tolist()}

    return run


def _compare(pivots: int, threshold: float):
    base = 1 + pivots

    def pairs(key: int, group: dict, apart: bool, counts: dict, edges: list) -> None:
        x, cells = group["x"], group["cell"]
        if apart:  # two blocks of one list
            left, right = np.flatnonzero(group["block"] == group["i"]), np.flatnonzero(group["block"] == group["j"])
        else:
            left = right = np.arange(len(x))
        near = x[left] @ x[right].T >= threshold
        if not apart:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        if not len(a):
            return
        names = []
        while key:
            key, part = divmod(key, base)
            names.append(part - 1)
        limit = max(names)
        hot = np.zeros((len(x), pivots), np.float32)
        np.put_along_axis(hot, cells, 1, axis=1)
        hot = hot[:, : limit + 1]
        first = np.rint((hot[left] @ hot[right].T)[a, b]) == len(names)
        a, b = left[a[first]], right[b[first]]
        if not len(a):
            return
        node, times = group["node"], group["times"]
        got = np.bincount(a, times[b], len(x)) + np.bincount(b, times[a], len(x))
        for i in np.flatnonzero(got):
            counts[int(node[i])] = counts.get(int(node[i]), 0) + int(got[i])
        label = np.arange(len(x))
        while True:  # smallest row that links reach, so that few edges keep all connections
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(x)))
        edges += zip(node[moved].tolist(), node[label[moved]].tolist())

    def run(batches):
        held: dict | None = None
        head = None

        def close(counts, edges):
            if held is not None and len(held["node"]) > 1:
                pairs(head[0], held | {"i": head[1], "j": head[2]}, head[1] != head[2], counts, edges)

        def result(counts, edges):
            n = len(counts)
            return {
                "a": [*counts, *(e[0] for e in edges)], "b": [None] * n + [e[1] for e in edges],
                "links": [*counts.values(), *[None] * len(edges)],
            }

        for batch in batches:
            if not batch.num_rows:
                continue
            counts, edges = {}, []
            heads = np.stack([np.asarray(batch.column(c)) for c in ("list", "i", "j")], 1)
            data = {c: np.asarray(batch.column(c)) for c in ("node", "times", "block")}
            data["x"] = _unit(batch.column("v"))
            data["cell"] = batch.column("cell").flatten().to_numpy().reshape(len(heads), -1).astype(np.int64)
            cuts = np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), len(heads)]
            for lo, hi in zip(bounds, bounds[1:]):
                here = tuple(heads[lo].tolist())
                part = {k: v[lo:hi] for k, v in data.items()}
                if here == head:
                    held = {k: np.concatenate([held[k], part[k]]) for k in part}
                else:
                    close(counts, edges)
                    held, head = part, here
            held = {k: v.copy() for k, v in held.items()}
            yield result(counts, edges)
        counts, edges = {}, []
        close(counts, edges)
        yield result(counts, edges)

    return run


def _met(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Counts of links (a, links) and edges that keep all connections (a, b) among vectors of one length."""
    pivots = choose_pivots(classes, pivot_count(n))
    kind = dict(classes.dtypes)["v"]
    described = pin(map_arrow(
        classes.select("node", "times", "v"), _describe(pivots),
        f"node bigint, times bigint, v {kind}, cell array<smallint>, lists array<bigint>",
    ))
    listed = described.select("node", F.explode("lists").alias("list"))
    crowded = pin(
        listed.groupBy("list").count().where(F.col("count") > LIST_BLOCK)
        .select("list", F.ceil(2 * F.col("count") / LIST_BLOCK).cast("int").alias("blocks"))
    )
    filed = described.select("node", "times", "v", "cell", F.explode("lists").alias("list")).join(crowded, "list", "left")
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0))))
    filed = filed.withColumn("block", own).withColumn("o", other)
    filed = filed.select(
        "list", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "times", "v", "cell"
    )
    return pin(map_arrow(
        filed.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j"), _compare(len(pivots), threshold),
        "a bigint, b bigint, links bigint",
    ))


def near_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """All columns of ``rows`` with ``n_links`` and ``component_id`` under the prefix ``base.OWN``.

    Vectors link at a cosine, in double precision, of ``threshold`` or more; pairs are found if their
    descriptions share ``SHARED`` points and always verified. ``n_links`` counts other rows, copies
    included. The component is the smallest non-null id reachable. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing and are their own component; those of
    different lengths do not link with each other. Equal vectors are compared once.
    """
    v = F.col(f"`{vector}`")
    node = f"{OWN}node"
    sound = F.size(v) > 0
    sound = sound & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    marked = rows.withColumn(node, F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(v)))
    usable = marked.where(F.col(node).isNotNull())
    classes = pin(
        usable.groupBy(F.col(node).alias("node"))
        .agg(F.first(v).alias("v"), F.count("*").alias("times"), F.min(f"`{id_column}`").alias("first"))
    )
    # Vectors of one length are compared with each other; a length that has one vector needs no comparison.
    widths = classes.groupBy(F.size("v").alias("w")).count().where("count > 1").collect()
    met = [_met(classes.where(F.size("v") == r["w"]), r["count"], threshold) for r in widths]
    none = rows.sparkSession.createDataFrame([], "a bigint, b bigint, links bigint")
    met = reduce(DataFrame.union, met, none)
    counted = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(met.where("b is not null"))
    rooted = classes.select("node", "times", "first").join(counted, "node", "left").join(roots, "node", "left")
    rooted = rooted.select("node", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias(f"{OWN}component"))
    named = rooted.join(smallest, "root").select(F.col("node").alias(node), F.col("links").alias(f"{OWN}links"), f"{OWN}component")
    out = marked.join(named, node, "left")
    alone = F.coalesce(F.col(f"{OWN}component"), F.col(f"`{id_column}`"))
    return out.withColumns({
        f"{OWN}n_links": F.coalesce(f"{OWN}links", F.lit(0)).cast("long"), f"{OWN}component_id": alone,
    }).drop(node, f"{OWN}links", f"{OWN}component")
