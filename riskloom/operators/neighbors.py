"""Exact k-nearest-neighbour search by a fitted tree of bounding boxes, and exact inner-product top-k.

Reference rows are dealt to the leaves of a tree whose number of leaves grows with the table; each leaf knows the box
around its rows. The tree and the dealt rows are fitted state: a search reads them as they are. A query looks into
its own leaf first; what it finds there gives a radius, and only leaves whose boxes the radius reaches are read
after it. Rows of one vector count as often as a query can need them, equal queries are asked once, and leaves and
their queries are cut into slices, so every task is of bounded size. Nothing is left out.

In many dimensions a radius reaches most leaves. Then queries are packed into blocks that meet all packed rows where these
lie: no vector is copied to a leaf, and what is shuffled are the best rows of each query from ``STREAMS`` parts of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.session import pin

LEAF_ROWS = 2_000  # of a leaf, as long as there are fewer than MAX_LEAVES
MAX_LEAVES = 1 << 14  # leaves beyond which they hold more rows and are cut into slices; bounds what is broadcast
SAMPLE_EACH = 8  # sampled rows a leaf from which the tree is cut
SLICE = 20_000  # rows of a leaf in one task
SALTS = 64
DENSE = 0.25  # share of the rows in reach of a query from which boxes are no help
PROBE = 256  # queries that tell this share
PACK_BYTES = 4 << 20  # of a block of rows or queries
PACK_ROWS = 8_192
STREAMS = 8  # parts of the rows that a block of queries meets side by side


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, width))
    return np.concatenate(vectors.to_numpy()).astype(np.float64, copy=False).reshape(len(vectors), width)


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows, without copying where Arrow allows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _nearest(q: np.ndarray, r: np.ndarray, r_ids: np.ndarray, take: int, step: int = 512):
    """Per query row: positions and exact distances of the ``take`` nearest rows of ``r`` (ties by id)."""
    take = min(take, len(r))
    slack = min(len(r), take + 16)
    r2 = (r * r).sum(1)
    r2_max = float(r2.max(initial=0.0))

    def best(q_row: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = np.sqrt(((q_row[:, None, :] - r[of]) ** 2).sum(2))
        order = np.lexsort((r_ids[of], exact), axis=1)[:, :take]
        return np.take_along_axis(of, order, 1), np.take_along_axis(exact, order, 1)

    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        rough = r2[None, :] - 2.0 * (part @ r.T)
        near = np.argpartition(rough, slack - 1, axis=1)[:, :slack] if slack < len(r) else np.tile(np.arange(len(r)), (len(part), 1))
        found, exact = best(part, near)
        if slack < len(r):
            # Rows with more candidates within rounding of the last place than the slack holds look at all of them.
            last = np.partition(rough, take - 1, axis=1)[:, take - 1] + 1e-10 * (r2_max + (part * part).sum(1))
            for i in np.flatnonzero((rough <= last[:, None]).sum(1) > slack):
                found[i : i + 1], exact[i : i + 1] = best(part[i : i + 1], np.flatnonzero(rough[i] <= last[i])[None, :])
        yield lo, found, exact


def _leaves(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf of each row: down the tree's planes."""
    axis, plane, left, right, leaf = tree
    node = np.zeros(len(x), np.int64)
    every = np.arange(len(x))
    while (axis[node] >= 0).any():
        f = axis[node]
        goes = x[every, np.maximum(f, 0)] <= plane[node]
        node = np.where(f < 0, node, np.where(goes, left[node], right[node]))
    return leaf[node]


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each row to each box."""
    out = np.empty((len(x), len(low)))
    step = max(1, (1 << 22) // max(1, low.size))
    for at in range(0, len(x), step):
        part = x[at : at + step, None, :]
        out[at : at + step] = np.sqrt((np.maximum(np.maximum(low - part, part - high), 0.0) ** 2).sum(2))
    return out


def _cut_tree(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, ...]:
    """Planes at the median of the widest side, the most crowded part first."""
    axis, plane, left, right = [-1], [0.0], [0], [0]
    parts, count = [(len(sample), 0, np.arange(len(sample)))], 1
    while count < leaves and parts:
        parts.sort(key=lambda p: (p[0], -p[1]))
        _, node, rows = parts.pop()
        spread = np.ptp(sample[rows], 0) if len(rows) else np.zeros(1)
        f = int(spread.argmax())
        if spread[f] <= 0:
            continue
        values = sample[rows, f]
        cut = float(np.median(values))
        goes = values <= cut
        if goes.all():  # the largest value is the median
            cut = float(values[values < cut].max())
            goes = values <= cut
        axis[node], plane[node], left[node], right[node] = f, cut, len(axis), len(axis) + 1
        for side in (rows[goes], rows[~goes]):
            parts.append((len(side), len(axis), side))
            axis.append(-1)
            plane.append(0.0)
            left.append(0)
            right.append(0)
        count += 1
    axis = np.array(axis)
    leaf = np.where(axis < 0, np.cumsum(axis < 0) - 1, -1)
    return axis, np.array(plane), np.array(left), np.array(right), leaf


@dataclass
class NeighborIndex:
    """A tree of boxes and the rows of its leaves."""

    tree: tuple[np.ndarray, ...]  # axis, plane, left, right, leaf by node
    low: np.ndarray  # by leaf; a leaf without rows has an empty box
    high: np.ndarray
    count: np.ndarray
    rows: DataFrame  # leaf, rid, rvec
    copies: int  # rows kept of one vector

    @classmethod
    def fit(cls, refs: DataFrame, k: int, id_col: str = "id", vec_col: str = "features", leaf_rows: int = LEAF_ROWS, seed: int = 0) -> "NeighborIndex":
        """An index that answers searches for up to ``k`` neighbours, the query itself not counted.

        Of equal vectors the ``k + 1`` smallest ids are kept: no search can need more, as ties go by id.
        """
        refs = refs.select(F.col(id_col).alias("rid"), F.col(vec_col).cast("array<double>").alias("rvec"))
        kept = pin(_first_of_each(refs, "rvec", "rid", k + 1))
        n = kept.count()
        leaves = max(1, min(MAX_LEAVES, -(-n // leaf_rows)))
        picked = kept.orderBy(F.xxhash64("rid", F.lit(seed)), "rid").limit(min(n, SAMPLE_EACH * leaves)).select("rvec").collect()  # MAX_LEAVES * SAMPLE_EACH at most
        sample = np.array([r["rvec"] for r in picked], np.float64).reshape(len(picked), -1)
        tree = _cut_tree(sample, leaves)
        leaves, width = int((tree[0] < 0).sum()), sample.shape[1]

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(leaf=_leaves(_matrix(b["rvec"], width), tree).astype("int32"))

        dealt = kept.mapInPandas(deal, T.StructType([*kept.schema.fields, T.StructField("leaf", T.IntegerType())]))
        dealt = pin(dealt.repartition("leaf", F.pmod(F.xxhash64("rid"), F.lit(SALTS))).sortWithinPartitions("leaf"))

        def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            low, high, count = np.full((leaves, width), np.inf), np.full((leaves, width), -np.inf), np.zeros(leaves, np.int64)
            for b in batches:
                x, at = _matrix(b["rvec"], width), b["leaf"].to_numpy()
                np.minimum.at(low, at, x)
                np.maximum.at(high, at, x)
                count += np.bincount(at, minlength=leaves)
            some = np.flatnonzero(count)
            yield pd.DataFrame({"leaf": some, "low": list(low[some]), "high": list(high[some]), "n": count[some]})

        parts = dealt.mapInPandas(boxes, "leaf int, low array<double>, high array<double>, n bigint")
        ends = lambda c, f: F.array(*[f(F.get(c, F.lit(i))) for i in range(width)]).alias(c)
        found = parts.groupBy("leaf").agg(ends("low", F.min), ends("high", F.max), F.sum("n").alias("n")).collect()
        low, high, count = np.full((leaves, width), np.inf), np.full((leaves, width), -np.inf), np.zeros(leaves, np.int64)
        for r in found:
            low[r["leaf"]], high[r["leaf"]], count[r["leaf"]] = r["low"], r["high"], r["n"]
        return cls(tree, low, high, count, dealt, k + 1)

    def search(
        self, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "features", exclude_self: bool = False, known: DataFrame | None = None
    ) -> DataFrame:
        """(query_id, rank, neighbor_id, distance): the k nearest rows, ties by id. Reads the leaves that queries reach.

        ``known``: what ``answers`` gave for as many neighbours; vectors in it are not looked for again.
        """
        if k > self.copies - (1 if exclude_self else 0):
            raise ValueError(f"the index was fitted for {self.copies - 1} neighbours")
        asked = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("qvec"))
        rid = self.rows.schema["rid"].dataType
        enough = k + 1 if exclude_self else k
        if int(self.count.sum()) == 0:
            fields = [("query_id", asked.schema["qid"].dataType), ("rank", T.IntegerType()), ("neighbor_id", rid), ("distance", T.DoubleType())]
            return asked.sparkSession.createDataFrame([], T.StructType([T.StructField(a, b) for a, b in fields]))
        if known is None:
            out = asked.join(self.answers(asked, enough, "qvec"), "qvec")
        else:
            out = pin(asked.join(known, "qvec", "left"))
            new = out.filter(F.col("near").isNull()).select("qid", "qvec")
            if not new.isEmpty():
                out = out.filter(F.col("near").isNotNull()).unionByName(new.join(self.answers(new, enough, "qvec"), "qvec"))
        if exclude_self:
            out = out.withColumn("near", F.filter("near", lambda e: ~e["neighbor_id"].eqNullSafe(F.col("qid"))))
        out = out.select(F.col("qid").alias("query_id"), F.posexplode(F.slice("near", 1, k)).alias("at", "e"))
        return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.neighbor_id", "e.distance")

    def answers(self, queries: DataFrame, enough: int, vec_col: str = "features") -> DataFrame:
        """(qvec, near): the ``enough`` nearest rows of each vector as (distance, neighbor_id), nearest first, ties by id."""
        asked = queries.select(F.col(vec_col).cast("array<double>").alias("qvec"))
        rid, n = self.rows.schema["rid"].dataType, int(self.count.sum())
        # Equal vectors are asked once, under a number of their own.
        once = asked.select("qvec").dropDuplicates().withColumn("q", F.monotonically_increasing_id())
        once = pin(once)
        tree, low, high, count, width = self.tree, self.low, self.high, self.count, self.low.shape[1]

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _matrix(b["qvec"], width)
                yield b.assign(leaf=_leaves(x, tree).astype("int32"), reach=np.inf)

        visit = T.StructType([*once.schema.fields, T.StructField("leaf", T.IntegerType()), T.StructField("reach", T.DoubleType())])
        first = pin(_best(self._look(once.mapInPandas(home, visit), enough, rid), enough))
        last = F.get("near", F.lit(enough - 1))["distance"]
        more = once.join(first, "q", "left").select("qvec", "q", F.coalesce(last, F.lit(float("inf"))).alias("far"))

        def reached(part: np.ndarray, far_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """How far each query must look, and the leaves that this reaches."""
            reach, gap = far_off, _gaps(part, low, high)
            if not np.isfinite(reach).all():  # enough rows lie inside the boxes that are wholly this near
                far = np.sqrt((np.maximum(np.abs(part[:, None, :] - low), np.abs(part[:, None, :] - high)) ** 2).sum(2))
                order = far.argsort(1)
                some = count[order].cumsum(1) >= enough
                bound = np.take_along_axis(far, np.take_along_axis(order, some.argmax(1)[:, None], 1), 1)[:, 0]
                reach = np.minimum(reach, np.where(some.any(1), bound, np.inf))
            return reach, (gap <= reach[:, None] * (1 + 1e-9)) & (count > 0)

        def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _matrix(b["qvec"], width)
                own = _leaves(x, tree)
                for at in range(0, len(x), 512):
                    part = x[at : at + 512]
                    reach, go = reached(part, b["far"].to_numpy(dtype=np.float64)[at : at + 512])
                    go[np.arange(len(part)), own[at : at + 512]] = False
                    row, leaf = np.nonzero(go)
                    yield pd.DataFrame({"qvec": b["qvec"].to_numpy()[at + row], "q": b["q"].to_numpy()[at + row], "leaf": leaf.astype("int32"), "reach": reach[row]})

        lists = None
        if len(count) > 4 and np.isfinite(low[count > 0]).all() and np.isfinite(high[count > 0]).all():
            asking = more.filter(_finite("qvec"))
            probe = asking.limit(PROBE).toPandas()
            if len(probe):
                _, go = reached(_matrix(probe["qvec"], width), probe["far"].to_numpy(dtype=np.float64))
                if (go * count).sum(1).mean() > DENSE * n:
                    found = _best(self._through(asking, enough, rid), enough)
                    odd = more.filter(~_finite("qvec"))
                    rest = self._look(odd.mapInPandas(further, visit), enough, rid)
                    rest = _best(_zipped(first.join(odd, "q", "left_semi")).unionByName(rest), enough)
                    lists = found.unionByName(rest)
        if lists is None:
            second = self._look(more.mapInPandas(further, visit), enough, rid)
            lists = _best(_zipped(first).unionByName(second), enough)
        return once.join(lists, "q").select("qvec", "near")

    def _look(self, visits: DataFrame, enough: int, rid: T.DataType) -> DataFrame:
        """(q, distances, ids) of the best ``enough`` rows for each visit of a leaf."""
        width = self.low.shape[1]
        # Slices of the leaves and of their queries, by counts; a slice of rows is copied to each slice of queries.
        visits = pin(visits)
        asked = {r["leaf"]: r["n"] for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
        cuts = [(i, max(1, -(-int(self.count[i]) // SLICE)), max(1, -(-m // max(256, SLICE // 10)))) for i, m in asked.items()]
        spark = visits.sparkSession
        if not cuts:
            cuts = [(-1, 1, 1)]
        table = F.broadcast(spark.createDataFrame(cuts, "leaf int, ref_cuts int, query_cuts int"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["leaf", "ref_cut", "query_cut"]
        refs = self.rows.join(table, "leaf").withColumn("ref_cut", F.pmod(F.xxhash64("rid"), F.col("ref_cuts")).cast("int"))
        refs = refs.withColumn("query_cut", spread("query_cuts")).select(*keys, "rid", "rvec")
        asks = visits.join(table, "leaf").withColumn("query_cut", F.pmod(F.xxhash64("q"), F.col("query_cuts")).cast("int"))
        asks = asks.withColumn("ref_cut", spread("ref_cuts")).select(*keys, "q", "qvec", "reach")

        schema = _found_schema(rid)
        shape = to_arrow_schema(schema)

        def search(a: pa.Table, r: pa.Table) -> pa.Table:
            if len(a) == 0 or len(r) == 0:
                return shape.empty_table()
            r = r.take(pc.sort_indices(r, [("rid", "ascending")]))
            ids, x = r.column("rid").combine_chunks(), _rows_of(r.column("rvec"), width)
            reach = a.column("reach").to_numpy() * (1 + 1e-9)
            count, which, gap = np.zeros(len(a), np.int64), [], []
            for lo, near, dist in _nearest(_rows_of(a.column("qvec"), width), x, np.arange(len(x)), enough):
                some = dist <= reach[lo : lo + len(near), None]
                count[lo : lo + len(near)] = some.sum(1)
                which.append(near[some])
                gap.append(dist[some])
            return _found(a.column("q").to_numpy(), count, np.concatenate(gap), ids.take(pa.array(np.concatenate(which))), shape)

        return asks.groupBy(*keys).cogroup(refs.groupBy(*keys)).applyInArrow(search, schema)

    def _through(self, asks: DataFrame, enough: int, rid: T.DataType) -> DataFrame:
        """(q, distances, ids) of the best ``enough`` of all rows for each query, from ``STREAMS`` parts of them at most.

        Both sides are packed and paired where they lie. A task holds the best so far of its queries.
        """
        width = self.low.shape[1]
        size = max(1, min(PACK_ROWS, PACK_BYTES // (8 * max(1, width))))
        spark = self.rows.sparkSession
        streams = max(1, min(STREAMS, -(-int(self.count.sum()) // size)))
        # Rows in the order of their ids, by which ties go.
        refs = self.rows.select("rid", "rvec").repartitionByRange(streams, "rid").sortWithinPartitions("rid").withColumn("r", F.monotonically_increasing_id())
        kind = T.StructType([T.StructField("r", T.BinaryType()), T.StructField("rid", T.ArrayType(rid)), T.StructField("rvec", T.BinaryType())])
        row_shape = to_arrow_schema(kind)

        def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _blocks(batches, size):
                ids = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column("rid").combine_chunks())
                columns = [pa.array([t.column("r").to_numpy().tobytes()], pa.binary()), ids, pa.array([_rows_of(t.column("rvec"), width).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, row_shape)], schema=row_shape)

        def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _blocks(batches, size):
                columns = {"q": t.column("q").to_numpy(), "qvec": _rows_of(t.column("qvec"), width), "far": t.column("far").to_numpy()}
                yield pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()})

        schema = _found_schema(rid)
        shape = to_arrow_schema(schema)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[bytes, _Best] = {}
            for b in batches:
                for i in range(b.num_rows):
                    q = b.column("q")[i].as_py()
                    if q not in held:
                        vectors = np.frombuffer(b.column("qvec")[i].as_py()).reshape(-1, width)
                        held[q] = _Best(vectors, np.frombuffer(b.column("far")[i].as_py()), enough)
                    ids = np.empty(len(b.column("rid")[i]), object)
                    ids[:] = b.column("rid")[i].as_py()
                    held[q].meet(np.frombuffer(b.column("rvec")[i].as_py()).reshape(-1, width), np.frombuffer(b.column("r")[i].as_py(), np.int64), ids)
            for q, best in held.items():
                some = np.isfinite(best.distance)
                ids = pa.array(best.ids[some].tolist(), shape.field("ids").type.value_type)
                yield from _found(np.frombuffer(q, np.int64), some.sum(1), best.distance[some], ids, shape).to_batches()

        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        before = spark.conf.get(name, None)
        rows = pin(refs.mapInArrow(pack_rows, kind))
        asks = asks.select("q", "qvec", "far").repartition(max(1, -(-asks.count() // size)), "q")
        asks = pin(asks.mapInArrow(pack_queries, "q binary, qvec binary, far binary"))
        spark.conf.set(name, str(PACK_BYTES))
        try:
            return pin(rows.crossJoin(asks).mapInArrow(meet, schema))
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)

    # -- fitted state ------------------------------------------------------------------------------

    def save(self, path: str) -> str:
        spark = self.rows.sparkSession
        nodes = [(i, int(a), float(p), int(x), int(y), int(z)) for i, (a, p, x, y, z) in enumerate(zip(*self.tree))]
        spark.createDataFrame(nodes, "node int, axis int, plane double, left int, right int, leaf int").coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")
        boxes = [(i, a.tolist(), b.tolist(), int(n), self.copies) for i, (a, b, n) in enumerate(zip(self.low, self.high, self.count))]
        spark.createDataFrame(boxes, "leaf int, low array<double>, high array<double>, n bigint, copies int").coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "NeighborIndex":
        nodes = spark.read.parquet(f"{path}/tree").orderBy("node").collect()
        tree = tuple(np.array([r[c] for r in nodes]) for c in ("axis", "plane", "left", "right", "leaf"))
        boxes = spark.read.parquet(f"{path}/boxes").orderBy("leaf").collect()
        low, high, count = (np.array([r[c] for r in boxes]) for c in ("low", "high", "n"))
        return cls(tree, low, high, count, spark.read.parquet(f"{path}/rows"), boxes[0]["copies"])


def _rows_of(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), width)


def _finite(vector: str):
    return F.coalesce(F.forall(vector, lambda x: F.abs(x) < F.lit(float("inf"))), F.lit(False))


def _found_schema(rid: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("q", T.LongType()), T.StructField("distances", T.ArrayType(T.DoubleType())), T.StructField("ids", T.ArrayType(rid))])


def _found(q: np.ndarray, count: np.ndarray, distances: np.ndarray, ids: pa.Array, shape: pa.Schema) -> pa.Table:
    """A row for each query with something found; ``distances`` and ``ids`` hold ``count`` entries for each, one after the other."""
    some = count > 0
    ends = pa.array(np.append(0, np.cumsum(count[some])), pa.int32())
    columns = [pa.array(q[some], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(distances, pa.float64())), pa.ListArray.from_arrays(ends, ids)]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)


def _zipped(lists: DataFrame) -> DataFrame:
    return lists.select("q", F.col("near.distance").alias("distances"), F.col("near.neighbor_id").alias("ids"))


def _best(found: DataFrame, enough: int) -> DataFrame:
    """(q, near): the best of all that was found for a query, at most ``enough`` from each visit."""
    pairs = F.arrays_zip(F.col("distances").alias("distance"), F.col("ids").alias("neighbor_id"))
    return found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, enough).alias("near"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        while len(t):
            room = size - sum(map(len, held))
            held.append(t.slice(0, room))
            t = t.slice(room)
            if sum(map(len, held)) == size:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


class _Best:
    """The nearest rows so far of a block of queries, none beyond ``far``."""

    def __init__(self, queries: np.ndarray, far: np.ndarray, enough: int):
        self.queries, self.length, self.far = queries, (queries * queries).sum(1), far * (1 + 1e-9)
        self.distance = np.full((len(queries), enough), np.inf)
        self.place = np.full((len(queries), enough), -1, np.int64)
        self.ids = np.full((len(queries), enough), None, object)

    def meet(self, rows: np.ndarray, place: np.ndarray, ids: np.ndarray, step: int = 512) -> None:
        enough, r2 = self.distance.shape[1], (rows * rows).sum(1)
        longest = r2[np.isfinite(r2)].max(initial=0.0)
        for at in range(0, len(self.queries), step):
            part, length = self.queries[at : at + step], self.length[at : at + step]
            bound = np.minimum(self.far[at : at + step], self.distance[at : at + step, -1])
            rough = r2[None, :] - 2.0 * (part @ rows.T)
            who, which = np.nonzero(rough <= ((bound * (1 + 1e-9)) ** 2 - length + 1e-9 * (longest + length))[:, None])
            if len(who) > 16 * enough * len(part):  # not much is known yet
                _, near, gap = next(_nearest(part, rows, np.arange(len(rows)), enough, step))
                who, which, gap = np.repeat(np.arange(len(part)), near.shape[1]), near.ravel(), gap.ravel()
            else:
                gap = np.sqrt(((part[who] - rows[which]) ** 2).sum(1))
            some = gap <= bound[who]
            who, which, gap = who[some], which[some], gap[some]
            if not len(who):
                continue
            mine = np.unique(who)
            row = np.concatenate([np.repeat(mine, enough), who])
            distance = np.concatenate([self.distance[at + mine].ravel(), gap])
            places = np.concatenate([self.place[at + mine].ravel(), place[which]])
            order = np.lexsort((places, distance, row))
            first = np.searchsorted(row[order], mine)
            order = order[first[:, None] + np.arange(enough)]
            names = np.concatenate([self.ids[at + mine].ravel(), ids[which]])
            self.distance[at + mine], self.place[at + mine], self.ids[at + mine] = distance[order], places[order], names[order]


def _first_of_each(rows: DataFrame, vector: str, id_col: str, most: int) -> DataFrame:
    """The ``most`` smallest ids of each vector, found in parts first, so that copies of one vector are no single task."""
    parts = Window.partitionBy(vector, F.pmod(F.xxhash64(id_col), F.lit(SALTS))).orderBy(id_col)
    some = rows.withColumn("_p", F.row_number().over(parts)).filter(F.col("_p") <= most)
    whole = Window.partitionBy(vector).orderBy(id_col)
    return some.withColumn("_p", F.row_number().over(whole)).filter(F.col("_p") <= most).drop("_p")


def knn_join(
    queries: DataFrame, refs: DataFrame, k: int, id_col: str = "id", vec_col: str = "features", exclude_self: bool = False, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest reference rows, ties by id; the index is used once."""
    return NeighborIndex.fit(refs, k, id_col, vec_col, leaf_rows).search(queries, k, id_col, vec_col, exclude_self)


QUERY_LIMIT = 4_096


def largest(scores: np.ndarray, ids: np.ndarray, take: int) -> np.ndarray:
    """Positions of the ``take`` largest of each row, ties by id: only what reaches the last place is put in order."""
    last = np.partition(-scores, take - 1, axis=1)[:, take - 1]
    out = np.empty((len(scores), take), np.int64)
    for i, row in enumerate(scores):
        some = np.flatnonzero(~(-row > last[i]))  # not a number comes last, but is not left out
        out[i] = some[np.lexsort((ids[some], -row[some]))[:take]]
    return out


def inner_product_top_k(
    queries: DataFrame, corpus: DataFrame, k: int = 3, id_col: str = "id", vec_col: str = "features",
    query_limit: int = QUERY_LIMIT,
) -> DataFrame:
    """(query_id, rank, match_id, score): exact top-k by inner product, fewer when the corpus is smaller.

    Up to ``query_limit`` queries travel to the corpus, which keeps k rows per query and task.
    Beyond it the search becomes a nearest-neighbour join: one extra coordinate gives all
    corpus rows the same length, which makes the nearest row the one of largest product.
    """
    queries = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("qvec"))
    corpus = corpus.select(F.col(id_col).alias("cid"), F.col(vec_col).cast("array<double>").alias("cvec"))
    head = queries.limit(query_limit + 1).collect()
    if len(head) > query_limit:
        return _by_distance(queries, corpus, k)
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["qid"].dataType),
            T.StructField("match_id", corpus.schema["cid"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if not head:
        return corpus.sparkSession.createDataFrame([], T.StructType([schema.fields[0], T.StructField("rank", T.IntegerType()), *schema.fields[1:]]))
    q_ids = np.array([r["qid"] for r in head])
    q = np.array([r["qvec"] for r in head], dtype=np.float64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for b in batches:
            ids = b["cid"].to_numpy()
            scores = q @ _matrix(b["cvec"], q.shape[1]).T
            take = min(k, len(ids))
            if take == 0:
                continue
            order = largest(scores, ids, take)
            new = pd.DataFrame(
                {
                    "query_id": np.repeat(q_ids, take),
                    "match_id": ids[order.ravel()],
                    "score": np.take_along_axis(scores, order, 1).ravel(),
                }
            )
            best = new if best is None else pd.concat([best, new], ignore_index=True)
            best = best.sort_values(["query_id", "score", "match_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    partial = corpus.mapInPandas(scan, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "match_id", "score")


def _by_distance(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    longest = corpus.agg(F.max(square("cvec"))).first()[0] or 0.0
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(longest)) - square("cvec")))
    refs = corpus.select(F.col("cid").alias("id"), F.concat("cvec", F.array(rest)).alias("features"))
    asks = queries.select(F.col("qid").alias("id"), F.concat("qvec", F.array(F.lit(0.0))).alias("features"))
    near = knn_join(asks, refs, k)
    product = F.aggregate(F.zip_with("qvec", "cvec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return (
        near.join(queries.withColumnRenamed("qid", "query_id"), "query_id")
        .join(corpus.withColumnRenamed("cid", "neighbor_id"), "neighbor_id")
        .select("query_id", "rank", F.col("neighbor_id").alias("match_id"), product.alias("score"))
    )
