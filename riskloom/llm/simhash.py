"""SimHash fingerprints of word shingles and their near-duplicate groups, by pigeonhole blocks.

Fingerprints that differ in at most k bits agree on at least m - k of m blocks. Each fingerprint is
filed under every choice of m - k blocks; only fingerprints filed together are compared. A bucket
that stays crowded is filed again by blocks of its remaining bits, whose number bounds its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import OWN, map_arrow
from riskloom.llm.components import components
from riskloom.session import pin

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
CROWDED = 2048  # fingerprints compared with each other in one task


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: those set in over half the hashes of the shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    span = min(shingle, len(words))
    starts = [0, *ends[: len(words) - span].tolist()]
    stops = (ends[span - 1 :] - 1).tolist()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_bits = (2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the text, with its fingerprint as a long in ``base.OWN`` + "fp".

    Words are runs of anything but ASCII white space, A to Z in lower case; fewer words than a
    shingle make one; a null or wordless text has fingerprint zero.
    """
    out = f"{OWN}fp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            values = batch.column(f"{OWN}text").cast(pa.binary()).to_pylist()
            yield {n: batch.column(n) for n in batch.schema.names} | {out: [fingerprint(v or b"", shingle) for v in values]}

    given = docs.withColumn(f"{OWN}text", docs[f"`{text}`"].cast("string")).drop(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != f"{OWN}text")
    return map_arrow(given, run, f"{schema}, {out} bigint")


@cache
def _masks(free: int, distance: int) -> tuple[int, ...]:
    """Masks of the bits that each choice of blocks of ``free`` covers."""
    bits = [i for i in range(64) if free >> i & 1]
    blocks = [sum(1 << b for b in part) for part in np.array_split(np.array(bits, object), min(BLOCKS, len(bits)))]
    keep = max(len(blocks) - distance, 0)
    return tuple(sum(c) for c in combinations(blocks, keep)) if keep else (0,)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refile(distance: int):
    def run(batches):
        for batch in batches:
            mask, fp = batch.column("mask").to_pylist(), batch.column("fp").to_pylist()
            rows = []
            for m, f in zip(mask, fp):
                m &= (1 << 64) - 1
                for extra in _masks(~m & ((1 << 64) - 1), distance):
                    rows.append((_signed(m | extra), _signed((f & ((1 << 64) - 1)) & (m | extra)), f))
            columns = np.array(rows, np.int64).reshape(-1, 3)
            yield {"mask": columns[:, 0], "key": columns[:, 1], "fp": columns[:, 2]}

    return run


def link_within(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what distances of at most ``distance`` connect among some fingerprints."""
    if len(values) == 2:
        a, b = values.tolist()
        return [(a, b)] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance else []
    bits = values.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(values)))
    return list(zip(values[moved].tolist(), values[label[moved]].tolist()))


def _compare(distance: int):
    def run(batches):
        rest: list = []
        last = None
        for batch in batches:
            mask, key, fp = (np.asarray(batch.column(c)) for c in ("mask", "key", "fp"))
            if not len(fp):
                continue
            edges: list = []
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            many = np.diff(bounds) > 1
            if last == (mask[0], key[0]):
                rest.append(fp[: bounds[1]])
            else:
                if sum(map(len, rest)) > 1:
                    edges += link_within(np.concatenate(rest), distance)
                rest = [fp[: bounds[1]]]
            if len(bounds) > 2:
                if sum(map(len, rest)) > 1:
                    edges += link_within(np.concatenate(rest), distance)
                for i in np.flatnonzero(many[1:-1]) + 1:
                    edges += link_within(fp[bounds[i] : bounds[i + 1]], distance)
                rest = [fp[bounds[-2] :]]
            last = (mask[-1], key[-1])
            columns = np.array(edges, np.int64).reshape(-1, 2)
            yield {"a": columns[:, 0], "b": columns[:, 1]}
        if sum(map(len, rest)) > 1:
            columns = np.array(link_within(np.concatenate(rest), distance), np.int64).reshape(-1, 2)
            yield {"a": columns[:, 0], "b": columns[:, 1]}

    return run


def near_edges(values: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges ``a``, ``b`` that connect distinct fingerprints ``fp`` wherever a chain of near ones does."""
    masks = _masks((1 << 64) - 1, distance)
    level = values.select(F.explode(F.array(*[
        F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks
    ])).alias("e"), "fp").select("e.*", "fp")
    found = []
    while True:
        crowded = pin(level.groupBy("mask", "key").count().where(F.col("count") > CROWDED).drop("count"))
        calm = level.join(crowded, ["mask", "key"], "left_anti")
        filed = calm.repartition("mask", "key").sortWithinPartitions("mask", "key")
        found.append(map_arrow(filed, _compare(distance), "a bigint, b bigint"))
        if crowded.isEmpty():
            break
        again = level.join(crowded, ["mask", "key"], "left_semi")
        level = pin(map_arrow(again, _refile(distance), "mask bigint, key bigint, fp bigint").distinct())
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` without the text, with ``fp`` and ``component`` under the prefix ``base.OWN``.

    The component is the smallest non-null id among all rows whose fingerprints a chain of
    distances of at most ``distance`` connects; null if none has an id. Every row stays. Copies
    share a fingerprint and are compared once. Empty input gives no rows.
    """
    fp = f"{OWN}fp"
    rows = pin(fingerprints(docs, text))
    groups = pin(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(f"`{id_column}`").alias("first")))
    roots = components(near_edges(groups.select("fp"), distance))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias(f"{OWN}component"))
    named = rooted.join(smallest, "root").select(F.col("fp").alias(fp), f"{OWN}component")
    return rows.join(named, fp)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
