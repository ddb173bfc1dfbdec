"""Groups of texts that share most of their word shingles: SimHash and min-hash bands find pairs, exact sets verify them.

Texts that the fingerprints of ``simhash`` link are verified against one of their group. Three differing bits reach only
texts that are almost the same, so bands find what else is similar enough. Texts are filed under every band of ``ROWS`` min-hashes of their shingles. In each file all texts are first verified
against one of them; what that joins needs no further look. A pair of exactly ``SIMILAR`` shares none of the bands
with probability (1 - 0.8 ** 5) ** 24 = 0.00007, a nearer one more rarely. The texts of files that are not joined yet
are compared by their rarest shingles: two sets that are similar enough share one of the rarest fifth of each, so
texts that have a template in common but not enough else never meet. Texts that meet are first compared with a few others
in rounds, since a few links join a large family; only pairs that are not joined by then are all looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.base import OWN, map_arrow, small_batches
from riskloom.llm.components import components
from riskloom.llm.simhash import fingerprint, near_edges
from riskloom.llm.wordstream import texts_of
from riskloom.session import pin

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 5, 24
PIECE = 1024  # shingles hashed at once
CUT = 256  # texts that are compared with one copy of a set
AHEAD = (4, 16, 64)  # texts beside it that a text is compared with in each round, before all pairs that are left
FEW = 64  # texts of a file whose pairs are looked at without rounds
_DRAWS = np.random.default_rng(42).integers(0, 1 << 64, (2, ROWS * BANDS), np.uint64)
_FLIPS, _FACTORS = _DRAWS[0], _DRAWS[1] | np.uint64(1)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle make one."""
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    span = min(shingle, len(words))
    starts = [0, *ends[: len(words) - span].tolist()]
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, (ends[span - 1 :] - 1).tolist())], np.uint64))


def bands(values: np.ndarray) -> list[int]:
    """A key for each band of min-hashes; no value, no key."""
    if not len(values):
        return []
    least = np.full(ROWS * BANDS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), PIECE):
        least = np.minimum(least, ((values[at : at + PIECE, None] ^ _FLIPS) * _FACTORS).min(axis=0))
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _name(words: list[bytes]) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words))) if words else 0


def _words(batch: pa.RecordBatch, name: str) -> Iterator[list[bytes]]:
    for text in texts_of(batch.column(name)):
        yield text.lower().split()


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        fp, size, keys, sim = [], [], [], []
        for words in _words(batch, f"{OWN}text"):
            values = shingles(words)
            fp.append(_name(words))
            size.append(len(values))
            keys.append(bands(values))
            sim.append(fingerprint(b" ".join(words), SHINGLE))
        yield {n: batch.column(n) for n in batch.schema.names} | {f"{OWN}fp": fp, f"{OWN}size": size, f"{OWN}keys": keys, f"{OWN}sim": sim}


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        fp, sets = [], []
        for words in _words(batch, "text"):
            fp.append(_name(words))
            sets.append(shingles(words).tobytes())
        yield {"fp": fp, "shingles": sets}


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pairs of a sorted stream in which the set of ``a`` comes before those that are compared with it."""
    at, own = None, None
    for batch in batches:
        found = []
        columns = [batch.column(c) for c in ("a", "cut", "b", "shingles")]
        for i in range(batch.num_rows):
            a, cut, b, raw = (c[i].as_py() for c in columns)
            values = np.frombuffer(raw, np.uint64)
            if b is None:
                at, own = (a, cut), values
            elif at == (a, cut) and similar(own, values):
                found.append((a, b))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield {"a": pairs[:, 0], "b": pairs[:, 1]}


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of texts that are similar. The set of ``a`` is sent once for every ``CUT`` texts compared with it."""
    cuts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CUT).cast("int").alias("cuts"))
    asked = pairs.join(cuts, "a").withColumn("cut", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int")).drop("cuts")
    asked = asked.join(sets.withColumnRenamed("fp", "b"), "b").select("a", "cut", "b", "shingles")
    hubs = sets.withColumnRenamed("fp", "a").join(cuts, "a")
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(None).cast("bigint").alias("b"), "shingles")
    stream = hubs.unionByName(asked).repartition("a", "cut").sortWithinPartitions("a", "cut", F.col("b").asc_nulls_first())
    return pin(map_arrow(stream, _verify, "a bigint, b bigint"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        sets = batch.column("shingles")
        for i in range(batch.num_rows):
            values = np.frombuffer(sets[i].as_py(), np.int64)
            same = lambda name: np.full(len(values), batch.column(name)[i].as_py(), np.int64)
            yield {"fp": same("fp"), "size": same("size").astype(np.int32), "root": same("root"), "token": values}


def _rarest(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The rarest shingles of texts (fp, size, root), with their place by rarity as ``rank``: a file for each shingle.

    Sets of sizes m and n that reach ``SIMILAR`` have at least ``SIMILAR`` of the larger one in common, so they meet
    among the rarest m - ceil(SIMILAR m) + 1 of the one and n - ceil(SIMILAR n) + 1 of the other, in any one order.
    """
    tokens = pin(map_arrow(texts.join(sets, "fp"), _tokens, "fp bigint, size int, root bigint, token bigint"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("n", "token"))
    least = F.ceil(F.col("size") * SIMILAR - 1e-9)
    return _open(tokens.join(often, "token").withColumn("rank", rank).where((F.col("rank") <= F.col("size") - least + 1) & (F.col("n") > 1)))


def _open(rare: DataFrame) -> DataFrame:
    """The files whose texts are not all of one root, with the number of their texts as ``n``."""
    parted = rare.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n")).where("r < s")
    return pin(rare.drop("n").join(parted, "token").select("token", "fp", "size", "root", "rank", "n"))


def _beside(ahead: int):
    """Pairs of texts of different roots that lie at most ``ahead`` apart in a stream ordered by file, if they can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, names = None, ("token", "fp", "size", "root", "rank")
        for batch in batches:
            now = {c: np.asarray(batch.column(c)).astype(np.int64) for c in names}
            old = 0 if held is None else len(held["fp"])
            if old:
                now = {c: np.concatenate([held[c], now[c]]) for c in names}
            found = []
            for step in range(1, min(ahead, len(now["fp"]) - 1) + 1):
                b = np.arange(max(step, old), len(now["fp"]))
                a = b - step
                fit = (now["token"][a] == now["token"][b]) & (now["root"][a] != now["root"][b])
                a, b = a[fit], b[fit]
                size, other = now["size"][a], now["size"][b]
                rest = np.minimum(size - now["rank"][a], other - now["rank"][b]) + 1
                fit = (np.minimum(size, other) >= SIMILAR * np.maximum(size, other) - 1e-9) & (rest * (1 + SIMILAR) >= SIMILAR * (size + other) - 1e-9)
                found.append(np.stack([now["fp"][a[fit]], now["fp"][b[fit]]], 1))
            pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0) if found else np.zeros((0, 2), np.int64)
            held = {c: now[c][-ahead:] for c in names}
            yield {"a": pairs[:, 0], "b": pairs[:, 1]}

    return run


def _in_rounds(rare: DataFrame, sets: DataFrame, seen: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Similar pairs that join the texts of files, the files that stay open with their new roots, and the pairs looked at.

    A text is compared with those beside it in each of its files, in an order of their own, so pairs are in proportion to
    what is filed however many texts a file has. Texts that are joined are not compared again, so later rounds look further.
    Files of up to ``FEW`` texts need no rounds.
    Nothing rests on a round: files cut between two tasks, and all that is not joined, are left to ``_pairs``.
    """
    found = []
    for ahead in AHEAD:
        crowded = rare.where(F.col("n") > FEW).drop("n")
        if crowded.isEmpty():
            break
        order = crowded.withColumn("draw", F.xxhash64("fp", "token", F.lit(ahead)))
        order = order.repartitionByRange("token", "draw").sortWithinPartitions("token", "draw").drop("draw")
        pairs = pin(map_arrow(order, _beside(ahead), "a bigint, b bigint").distinct().join(seen, ["a", "b"], "left_anti"))
        near = _verified(pairs, sets)
        seen = seen.union(pairs)
        if near.isEmpty():
            break
        found.append(near)
        known = rare.select(F.col("fp").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        roots = components(known.union(near)).select(F.col("node").alias("fp"), F.col("root").alias("to"))
        rare = _open(rare.join(roots, "fp", "left").withColumn("root", F.coalesce("to", "fp")))
    return found, rare, seen


def _pairs(rare: DataFrame) -> DataFrame:
    """All pairs of texts of different roots that meet in a file and can be similar.

    Where two texts meet first, at places i and j of m and n, they have no more in common than that shingle and the fewer of
    the m - i and n - j after it; a pair that can reach too little that way is not formed, so texts of a template that
    differ in more than a ninth of their shingles do not meet by what some of them share beside it.
    """
    left, right = (rare.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("size", "root", "rank")], F.col("fp").alias(x)) for x in "ab")
    rest = F.least(F.col("size_a") - F.col("rank_a"), F.col("size_b") - F.col("rank_b")) + 1
    reach = rest * (1 + SIMILAR) >= SIMILAR * (F.col("size_a") + F.col("size_b")) - 1e-9
    both = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _near() & reach)
    return both.select("a", "b").distinct()


def _by_rarest(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of texts (fp, size, root) of different roots that share one of the rarest shingles of both and can be similar."""
    return _pairs(_rarest(texts, sets))


def _near() -> Column:
    return F.least("size_a", "size_b") >= SIMILAR * F.greatest("size_a", "size_b") - 1e-9


def _linked(named: DataFrame) -> DataFrame:
    """Pairs of texts (fp, size, sim) to verify: one of each group that SimHash links, with every other of near size."""
    named = pin(named.distinct())
    roots = components(near_edges(named.select(F.col("sim").alias("fp")).distinct()))
    grouped = pin(named.join(roots, named["sim"] == roots["node"], "left").select("fp", "size", F.coalesce("root", "sim").alias("root")))
    hubs = grouped.groupBy("root").agg(F.min(F.struct("fp", "size")).alias("h"), F.max("fp").alias("last")).where("h.fp < last")
    pairs = grouped.join(hubs.select("root", "h"), "root").where("fp <> h.fp")
    pairs = pairs.select(F.col("h.fp").alias("a"), F.col("h.size").alias("size_a"), F.col("fp").alias("b"), F.col("size").alias("size_b"))
    return pairs.where(_near()).select("a", "b")


def similar_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``fp`` and ``component`` under the prefix ``base.OWN``.

    ``fp`` names the words of the text. The component is the smallest non-null id among all rows that a
    chain of texts of at least ``SIMILAR`` connects by the Jaccard similarity of their shingles; null if
    none has an id. Null and wordless texts are one group. Every row stays.
    """
    with small_batches(docs.sparkSession):
        return _grouped(docs, id_column, text)


def _grouped(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    fp = f"{OWN}fp"
    given = docs.withColumn(f"{OWN}text", docs[f"`{text}`"].cast("string")).drop(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != f"{OWN}text")
    rows = pin(map_arrow(given, _file, f"{schema}, {fp} bigint, {OWN}size int, {OWN}keys array<bigint>, {OWN}sim bigint"))
    linked = pin(_linked(rows.select(F.col(fp).alias("fp"), F.col(f"{OWN}size").alias("size"), F.col(f"{OWN}sim").alias("sim"))))
    filed = rows.select(F.col(fp).alias("fp"), F.col(f"{OWN}size").alias("size"), F.explode(f"{OWN}keys").alias("key")).distinct()
    shared = filed.groupBy("key").agg(F.min(F.struct("fp", "size")).alias("h"), F.max("fp").alias("last")).where("h.fp < last")
    filed = pin(filed.join(shared.select("key", "h"), "key"))
    named = filed.select("fp").union(linked.select("a")).union(linked.select("b")).distinct()
    sets = map_arrow(docs.select(docs[f"`{text}`"].cast("string").alias("text")), _sets, "fp bigint, shingles binary")
    sets = pin(sets.join(named, "fp", "left_semi").dropDuplicates(["fp"]))
    stars = filed.where("fp <> h.fp").select(F.col("h.fp").alias("a"), F.col("h.size").alias("size_a"), F.col("fp").alias("b"), F.col("size").alias("size_b"))
    stars = pin(stars.where(_near()).select("a", "b").union(linked).distinct())
    edges = _verified(stars, sets)
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = filed.join(roots, "fp", "left").select("key", "fp", "size", F.coalesce("root", "fp").alias("root"))
    # Only texts of files that are not all joined yet have pairs left to look at.
    parted = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    texts = pin(rooted.join(parted, "key").select("fp", "size", "root").distinct())
    found, rare, seen = _in_rounds(_rarest(texts, sets), sets, stars)
    found.append(_verified(pin(_pairs(rare).join(seen, ["a", "b"], "left_anti")), sets))
    roots = components(reduce(DataFrame.union, found, edges))
    groups = rows.groupBy(F.col(fp).alias("fp")).agg(F.min(f"`{id_column}`").alias("first"))
    rooted = pin(groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias(f"{OWN}component"))
    names = rooted.join(smallest, "root").select(F.col("fp").alias(fp), F.col("root").alias(f"{OWN}root"), f"{OWN}component")
    return rows.drop(f"{OWN}size", f"{OWN}keys", f"{OWN}sim").join(names, fp)
