"""Removal of byte strings that occur more than once, by suffix arrays.

Every window of ``length`` bytes is filed under the smallest hash of the short grams inside it,
so equal windows are filed together and a run of neighbouring windows makes one segment. Hashes
that only one place has chosen cannot hold a repeat and are dropped. Segments of the others meet
by hash; a suffix array by two-stage sorting, cut at ``length``, and the common prefixes of its
neighbours tell which windows occur twice. Hashes chosen very often are filed again by bytes that
neighbouring windows share, and the most frequent by whole windows, which bounds every task. Equal segments merge before they are shuffled or sorted and
carry how often they occur; a hash with a single segment has no neighbours to compare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import KEY, OWN, map_arrow, small_batches, text_key
from riskloom.llm.sorting import common_prefix, suffix_array
from riskloom.session import pin

GRAM = 24  # bytes of the hashed grams
# Places of one hash beyond which it is filed again by the bytes that so many neighbouring windows share;
# by single windows, equal segments are all that is left to meet.
CROWDED = {4_096: 32, 32_768: 8, 1_048_576: 1}
HELD_BYTES = 1 << 25  # distinct segments held by a task before it hands them on
SORT_SYMBOLS = 1 << 19  # symbols sorted at once
BLOCK_BYTES = 1 << 20  # bytes hashed at once, unless one text is longer; their hashes take some 60 times as much

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: span - width], values[width - span :]) if span < width else values


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` = 24 bytes at every position."""
    words = np.lib.stride_tricks.as_strided(data, shape=(len(data) - 7, 8), strides=(1, 1))
    h = np.ascontiguousarray(words).view(np.uint64).ravel() * _A
    h ^= h >> np.uint64(29)
    out = h[: len(data) - GRAM + 1] * _B
    for off in (8, 16):
        out += h[off : off + len(out)]
        out *= _A
        out ^= out >> np.uint64(31)
    return out


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


class _Block:
    """Window minima over some texts laid end to end."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        raw = np.frombuffer(self.data, np.uint8)
        self.width = length - GRAM + 1
        self.grams = _gram_hashes(raw) if len(raw) >= length else np.zeros(0, np.uint64)
        self.least = _slide(self.grams, self.width, np.minimum) if len(raw) >= length else self.grams
        inside = np.zeros(len(raw) + 1, np.int8)
        whole = sizes >= length
        np.add.at(inside, (self.ends - sizes)[whole], 1)
        np.add.at(inside, self.ends[whole] - length + 1, -1)
        self.valid = np.cumsum(inside, dtype=np.int8)[: len(self.least)] > 0

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose gram is the smallest of some window, and the text each belongs to."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A gram is chosen if no window over it has a larger minimum than itself.
        edge = np.zeros(self.width - 1, np.uint64)
        masked = np.concatenate([edge, np.where(self.valid, self.least, 0), edge])
        best = _slide(masked, self.width, np.maximum)
        at = np.flatnonzero((best == self.grams[: len(best)]) & (best > 0))
        return at, np.searchsorted(self.ends, at, side="right")

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, count and text of every run of windows with one minimum."""
        if not self.valid.any():
            return (np.zeros(0, np.int64),) * 3
        change = np.ones(len(self.least), bool)
        change[1:] = (self.least[1:] != self.least[:-1]) | (self.valid[1:] != self.valid[:-1])
        at = np.flatnonzero(change)
        count = np.diff(np.append(at, len(self.least)))
        at, count = at[self.valid[at]], count[self.valid[at]]
        return at, count, np.searchsorted(self.ends, at, side="right")


def _bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def _choose(length: int):
    def run(batches):
        for batch in batches:
            texts = _bytes(batch, f"{OWN}text")
            hashes, sizes = (np.asarray(batch.column(k)) for k in KEY)
            for first, part in _blocks(texts):
                block = _Block(part, length)
                at, of = block.chosen()
                if len(at):
                    rows = np.zeros(len(at), [("of", np.int64), ("gram", np.uint64)])
                    rows["of"], rows["gram"] = of, block.grams[at]
                    rows, times = np.unique(rows, return_counts=True)
                    of = rows["of"] + first
                    yield {"gram": rows["gram"].view(np.int64), KEY[0]: hashes[of], KEY[1]: sizes[of], "times": times.astype(np.int32)}

    return run


def _pieces(block: _Block, at: int, count: int, least: np.uint64, split: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """Parts of a run of windows as first window, count, and the bytes that all windows of the part share.

    Parts are told by the distance to the next smallest gram, which a window's own bytes decide.
    """
    spots = np.flatnonzero(block.grams[at : at + count + block.width - 1] == least) + at
    windows = np.arange(at, at + count)
    anchor = spots[np.searchsorted(spots, windows)]
    part = (anchor - windows) // split
    cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), count]):
        core = int(anchor[lo] - part[lo] * split)
        yield at + lo, hi - lo, block.data[core : core + length - split + 1]


def _segments(length: int, contents: bool):
    """Segments of repeated hashes: with ``contents`` what they hold, else where they stand."""

    def run(batches):
        seen: dict = {}
        held = 0

        def flush() -> dict:
            return {
                "gram": [k[0] for k in seen], "digest": [k[1] for k in seen],
                "piece": [v[0] for v in seen.values()], "times": [v[1] for v in seen.values()],
            }

        for batch in batches:
            texts = _bytes(batch, f"{OWN}text")
            hashes, sizes = (np.asarray(batch.column(k)) for k in KEY)
            grams = batch.column("grams")
            wanted = grams.values.to_numpy(zero_copy_only=False).view(np.uint64)
            splits = batch.column("splits").values.to_numpy(zero_copy_only=False)
            starts = grams.offsets.to_numpy()
            for first, part in _blocks(texts):
                block = _Block(part, length)
                at, count, of = block.runs()
                low, high = starts[first], starts[first + len(part)]
                pool, turn = np.unique(wanted[low:high], return_index=True)
                if not len(pool) or not len(at):
                    continue
                least = block.least[at]
                slot = np.minimum(np.searchsorted(pool, least), len(pool) - 1)
                known = pool[slot] == least
                at, count, of, least = at[known], count[known], of[known], least[known]
                split_of = splits[low:high][turn][slot[known]]
                begin = block.ends - np.array([len(t) for t in part], np.int64)
                rows = []
                names = least.view(np.int64).tolist()
                for i, (a, n, d, h, split) in enumerate(zip(at.tolist(), count.tolist(), of.tolist(), names, split_of.tolist())):
                    for lo, m, core in _pieces(block, a, n, least[i], split, length) if split else [(a, n, None)]:
                        piece = block.data[lo : lo + m + length - 1]
                        digest = xxhash.xxh3_128_digest(piece)
                        name = h if core is None else xxhash.xxh3_64_intdigest(core) - (1 << 63)
                        if not contents:
                            rows.append((name, digest, d + first, lo - int(begin[d])))
                        elif (name, digest) in seen:
                            seen[name, digest][1] += 1
                        else:
                            seen[name, digest] = [piece, 1]
                            held += len(piece)
                if held >= HELD_BYTES:
                    yield flush()
                    seen, held = {}, 0
                if rows:
                    rows_of = np.array([r[2] for r in rows])
                    yield {
                        "gram": [r[0] for r in rows], "digest": [r[1] for r in rows],
                        KEY[0]: hashes[rows_of], KEY[1]: sizes[rows_of], "at": [r[3] for r in rows],
                    }
        if seen:
            yield flush()

    return run


def _ranges(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true flags, in one list."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()


def repeats(pieces: list[bytes], times: list[int], length: int) -> list[list[int]]:
    """Which windows of each piece occur again, in it or in another, as starts and ends of runs.

    All pieces are distinct; ``times`` is how often each stands in the corpus.
    """
    sizes = np.array([len(p) for p in pieces])
    text = np.zeros(int(sizes.sum()) + len(pieces), np.uint16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inner = np.ones(len(text), bool)
    inner[starts + sizes] = False
    text[inner] = np.frombuffer(b"".join(pieces), np.uint8)
    text[inner] += 1
    order = suffix_array(text, length)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = np.arange(len(text)) - starts[owner]
    order = order[(offset <= sizes[owner] - length)[order]]
    same = common_prefix(text, order, length)
    twice = np.zeros(len(text), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return [
        [0, int(n) - length + 1] if k > 1 else _ranges(twice[s : s + n - length + 1])
        for s, n, k in zip(starts.tolist(), sizes.tolist(), times)
    ]


def _sorted_repeats(length: int):
    def flush(rows: list) -> dict:
        alone = [r for r in rows if r[4]]
        met = [r for r in rows if not r[4]]
        out = [(r[0], r[1], [0, len(r[2]) - length + 1]) for r in alone if r[3] > 1]
        if met:
            found = repeats([r[2] for r in met], [r[3] for r in met], length)
            out += [(r[0], r[1], f) for r, f in zip(met, found) if f]
        return {"gram": [r[0] for r in out], "digest": [r[1] for r in out], "marks": [r[2] for r in out]}

    def run(batches):
        rows: list = []  # whole hashes waiting for the sort
        group: list = []  # of the hash being read
        size = 0
        for batch in batches:
            for gram, digest, piece, times in zip(*(batch.column(c).to_pylist() for c in ("gram", "digest", "piece", "times"))):
                if group and group[0][0] != gram:
                    # One segment alone is compared with itself only where its windows could overlap a repeat.
                    single = len(group) == 1 and group[0][3] > 1
                    rows += [(*g, single) for g in group]
                    group = []
                    if size >= SORT_SYMBOLS:
                        yield flush(rows)
                        rows, size = [], 0
                group.append((gram, digest, piece, times))
                size += len(piece)
        single = len(group) == 1 and group[0][3] > 1
        rows += [(*g, single) for g in group]
        if rows:
            yield flush(rows)

    return run


def repeated_ranges(keyed: DataFrame, length: int = 200) -> DataFrame:
    """Byte ranges of each distinct text that strings of ``length`` bytes occurring twice cover.

    ``keyed`` has the columns of ``text_key`` and the text. Result: the key and ``ranges``, pairs
    of first byte and byte after the last, not merged; texts without repeats have no row.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    key = f"{KEY[0]} bigint, {KEY[1]} bigint"
    long_enough = keyed.where(F.col(KEY[1]) >= length)
    with small_batches(keyed.sparkSession):
        chosen = pin(map_arrow(long_enough.select(*KEY, f"{OWN}text"), _choose(length), f"gram bigint, {key}, times int"))
    often = chosen.groupBy("gram").agg(F.sum("times").alias("places")).where("places > 1")
    split = F.lit(0)
    for places, windows in sorted(CROWDED.items()):
        split = F.when(F.col("places") > places, windows).otherwise(split)
    wanted = (
        chosen.join(often.select("gram", split.alias("split")), "gram")
        .select(*KEY, "gram", "split").groupBy(*KEY)
        .agg(F.collect_set(F.struct("gram", "split")).alias("w"))
        .select(*KEY, F.col("w.gram").alias("grams"), F.col("w.split").alias("splits"))
    )
    hit = keyed.join(wanted, KEY)
    pieces = map_arrow(hit, _segments(length, True), "gram bigint, digest binary, piece binary, times int")
    merged = pieces.groupBy("gram", "digest").agg(F.min("piece").alias("piece"), F.sum("times").alias("times"))
    marks = map_arrow(
        merged.repartition("gram").sortWithinPartitions("gram"), _sorted_repeats(length),
        "gram bigint, digest binary, marks array<int>",
    )
    places = map_arrow(hit, _segments(length, False), f"gram bigint, digest binary, {key}, at int")
    spot = F.transform(F.col("marks"), lambda x, i: x + F.col("at") + F.when(i % 2 == 1, F.lit(length - 1)).otherwise(F.lit(0)))
    return places.join(marks, ["gram", "digest"]).groupBy(*KEY).agg(F.flatten(F.collect_set(spot)).alias("ranges"))


def merge_ranges(flat: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs from unordered, overlapping pairs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(flat[::2], flat[1::2])) if flat else []:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _cut(with_kept: bool):
    def run(batches):
        for batch in batches:
            removed, spans, digests, kept = [], [], [], []
            for t, flat in zip(_bytes(batch, f"{OWN}text"), batch.column(f"{OWN}ranges").to_pylist()):
                runs = merge_ranges(flat)
                removed.append(sum(hi - lo for lo, hi in runs))
                spans.append(len(runs))
                left, at = [], 0
                for lo, hi in runs:
                    left.append(t[at:lo])
                    at = hi
                rest = b"".join([*left, t[at:]]) if runs else t
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
            own = {f"{OWN}removed": removed, f"{OWN}spans": spans, f"{OWN}sha": digests, f"{OWN}kept": kept}
            yield {n: batch.column(n) for n in batch.schema.names} | own

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, with_kept: bool = True) -> DataFrame:
    """All columns of ``docs`` but the text, with the kept bytes and counts of each row.

    Every byte covered by a string of ``length`` bytes that starts anywhere else too goes, first
    occurrences included; strings are judged on the input. Added, under the prefix ``base.OWN``:
    ``size``, ``removed``, ``spans``, ``sha`` (of the kept bytes) and ``kept`` (null unless asked for).
    A null text is empty; repeated rows are copies of each other and lose everything but texts
    shorter than ``length``. Rows keep their number; ids are not used, so they may be null or repeat.
    """
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    keyed = docs.withColumns({f"{OWN}text": body, **text_key(body)}).drop(text)
    joined = keyed.join(repeated_ranges(keyed, length).withColumnRenamed("ranges", f"{OWN}ranges"), KEY, "left")
    own = f"{OWN}removed bigint, {OWN}spans bigint, {OWN}sha string, {OWN}kept binary"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in (f"{OWN}ranges", f"{OWN}text"))
    return map_arrow(joined, _cut(with_kept), f"{schema}, {own}").drop(KEY[0])
