"""Periodic runs of words, found while the words arrive.

A catcher sits on every completed block of 2, 4, 8, … words. Each appended word ends one suffix of every such
length; the suffix is compared with the few blocks that lie one admissible period before it. A match is a part of
a square; it is followed to both sides, and squares of one period that overlap merge into a run. Suffixes and
blocks are compared by 64-bit digests that are doubled from level to level, and every reported run is checked
word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import OWN, map_arrow
from riskloom.llm.wordstream import SLICE, numbered, texts_of

MIN_LENGTH, MIN_EXPONENT = 24, 3
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _TURN
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Growing:
    """An array that grows at its end; its room doubles, so appending one by one stays cheap."""

    def __init__(self, dtype: type):
        self.room, self.size = np.zeros(16, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(max(need, len(self.room) * 2) - self.size, self.room.dtype)])
        self.room[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class SquareCatcher:
    """Runs of period p and at least ``max(min_length, min_exponent * p)`` words in a stream that grows by ``append``.

    Words are whole numbers; appending them one by one or many at once gives the same. ``segment`` numbers
    tell streams apart that are appended one after the other: no run reaches over a change of segment.
    A stretch that repeats its words p words before holds at least ``max(min_length - p, (min_exponent - 1) * p)``
    words, so it holds a whole block of length b if 2 b - 1 is not more than that: every period has one level,
    that of the longest such block. An appended word costs a bounded number of comparisons on each of the
    log n levels.
    """

    def __init__(self, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
        if min_exponent < 2 or min_length < 2:
            raise ValueError("a run has at least two words and an exponent of at least two")
        self.min_length, self.min_exponent = min_length, min_exponent
        self._words = Growing(np.int64)
        self._kept: list[Growing] = [Growing(np.uint64)]  # by level: digests of 2 ** level words by their start
        self._compared: list[int] = []  # by level: suffixes that have met the blocks before them
        self._spans: list[range] = []  # by level: its periods
        self._open: set[tuple[int, int]] = set()  # period and last matched block of each stretch
        self._segment, self._length, self.longest = None, 0, 0  # the last segment, its words, and those of the longest
        self.stretches: list[tuple[int, int]] = []  # period and a place inside of each caught stretch

    @property
    def words(self) -> np.ndarray:
        return self._words.values

    def _level(self, period: int) -> int:
        least = max(self.min_length - period, (self.min_exponent - 1) * period)
        return ((least + 1) // 2).bit_length() - 1

    def _periods(self, level: int) -> range:
        """The periods whose stretches are caught by blocks of 2 ** level words."""
        while len(self._spans) <= level:
            at = len(self._spans)
            found = [p for p in range(1, self.min_length + 1) if self._level(p) == at]
            step = self.min_exponent - 1  # beyond min_length the level depends on (min_exponent - 1) * p alone
            low = max(self.min_length + 1, -(-((2 << at) - 1) // step))
            high = ((4 << at) - 2) // step
            found += [p for p in (low, high) if p >= low and self._level(p) == at]
            self._spans.append(range(min(found), max(found) + 1) if found else range(0))
        return self._spans[level]

    def _grow(self, segments: np.ndarray) -> None:
        """Keeps the length of the longest segment."""
        edges = np.concatenate([[0], np.flatnonzero(np.diff(segments)) + 1, [len(segments)]])
        lengths = np.diff(edges)
        if segments[0] == self._segment:
            lengths[0] += self._length
        self._segment, self._length = int(segments[-1]), int(lengths[-1])
        self.longest = max(self.longest, int(lengths.max()))

    def append(self, words: np.ndarray, segment: np.ndarray | int = 0) -> list[tuple[int, int]]:
        """Takes words; returns (period, place) of the stretches that they newly catch."""
        words = np.asarray(words, np.int64)
        if not len(words):
            return []
        segments = np.broadcast_to(np.asarray(segment, np.int64), words.shape)
        self._grow(segments)
        self._words.extend(words)
        with np.errstate(over="ignore"):
            self._kept[0].extend(mix(words.astype(np.uint64) * _MIX + mix(segments.astype(np.uint64) + _TURN)))
        caught: list[tuple[int, int]] = []
        level, n = 0, self._words.size
        # A run of period p has min_exponent * p words, so longer periods than this cannot make one.
        while (1 << level) <= n and (not (p := self._periods(level)) or p[0] * self.min_exponent <= self.longest):
            if len(self._compared) == level:
                self._compared.append(0)
            if level:
                if len(self._kept) == level:
                    self._kept.append(Growing(np.uint64))
                half, lower = 1 << (level - 1), self._kept[level - 1].values
                done, most = self._kept[level].size, n - (1 << level) + 1
                with np.errstate(over="ignore"):
                    self._kept[level].extend(mix(lower[done:most] * _MIX + lower[done + half : most + half]))
            if p:
                caught += self._compare(level, p)
            level += 1
        self.stretches += caught
        return caught

    def _compare(self, level: int, periods: range) -> list[tuple[int, int]]:
        """Compares every new suffix of 2 ** level words with the blocks an admissible period before it."""
        size, digest = 1 << level, self._kept[level].values
        starts = np.arange(self._compared[level], len(digest))
        self._compared[level] = len(digest)
        hits = []
        nearest = (starts - periods[0]) >> level
        for back in range(-(-len(periods) // size) + 1):
            block = (nearest - back) << level
            fit = (block >= 0) & (starts - block <= periods[-1])
            at, block = starts[fit], block[fit]
            same = digest[at] == digest[block]
            hits.append(np.stack([at[same] - block[same], block[same] >> level], 1))
        hits = np.concatenate(hits)
        if not len(hits):
            return []
        # Matches of one period in neighbouring blocks belong to one stretch.
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        first = np.ones(len(hits), bool)
        first[1:] = (np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 1)
        begun = hits[first].tolist()
        new = [(p, b << level) for p, b in begun if (p, b - 1) not in self._open]
        self._open.difference_update((p, b - 1) for p, b in begun)
        self._open.update((p, b) for p, b in hits[np.append(first[1:], True)].tolist())
        return new

    def _reach(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``a`` and ``b`` on are the same, forwards (step 1) or backwards (-1)."""
        n, got = self._words.size, np.zeros(len(a), np.int64)
        for level in reversed(range(len(self._kept))):
            size, digest = 1 << level, self._kept[level].values
            # Of every length the largest may fit more than once; all others once.
            todo = np.arange(len(a))
            while len(todo):
                x, y = (a[todo] + got[todo], b[todo] + got[todo]) if step > 0 else (a[todo] - got[todo] - size, b[todo] - got[todo] - size)
                fit = (x >= 0) & (y + size <= n)
                todo, x, y = todo[fit], x[fit], y[fit]
                todo = todo[digest[x] == digest[y]]
                got[todo] += size
                if level < len(self._kept) - 1:
                    break
        return got

    def runs(self) -> np.ndarray:
        """(start, length, period) of every run so far, by start and period; periods are the smallest ones."""
        if not self.stretches:
            return np.zeros((0, 3), np.int64)
        period, place = np.unique(np.array(self.stretches, np.int64), axis=0).T
        start = place - self._reach(place, place + period, -1)
        end = place + period + self._reach(place, place + period, 1)
        long = end - start >= np.maximum(self.min_length, self.min_exponent * period)
        found = np.unique(np.stack([start, end, period], 1)[long], axis=0)
        # Multiples of a period cover the same words; the first of each place is the smallest.
        keep = np.ones(len(found), bool)
        keep[1:] = (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)
        found = found[keep]
        for s, e, p in found.tolist():
            if not np.array_equal(self.words[s : e - p], self.words[s + p : e]):
                raise ArithmeticError("two different stretches of words have one digest")
        return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], 1)


def planted(words: list[bytes], key: str) -> list[bytes]:
    """The words that the query of this operator looks at: every tenth document is made to end periodically."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _report(words: list[bytes], runs: list[list[int]]) -> dict:
    text = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = words
    if runs:
        drop = np.zeros(len(words), bool)
        for s, length, p in runs:
            drop[s + p : s + length] = True
        kept = [words[i] for i in np.flatnonzero(~drop).tolist()]
    best = None
    for s, length, p in runs:  # by start and period, so that a later one of equal exponent is no better
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    out = {"n_runs": len(runs), "runs_sha256": hashlib.sha256(text.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}
    s, length, p = best or (None, None, None)
    return out | {"start": s, "length": length, "period": p, "exponent_milli": best and 1000 * length // p, "runs": runs, "collapsed": kept}


FIELDS = {
    "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint",
    "runs_sha256": "string", "collapsed_sha256": "string",
}


def _slices(batches: Iterator[pa.RecordBatch], id_column: str, text: str, plant: bool) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Parts of batches with the words of their texts, of about ``SLICE`` bytes each."""
    for batch in batches:
        keys = batch.column(id_column).cast(pa.string()).to_pylist() if plant else []
        first, held, words = 0, 0, []
        for i, raw in enumerate(texts_of(batch.column(text))):
            words.append(planted(raw.split(), keys[i] or "") if plant else raw.split())
            held += len(raw)
            if held >= SLICE:
                yield batch.slice(first, i + 1 - first), words
                first, held, words = i + 1, 0, []
        if words:
            yield batch.slice(first), words


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", plant: bool = False, with_text: bool = False,
                  min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` without its text, with the runs of the words of each text under the prefix ``base.OWN``.

    Words are separated by ASCII white space. Columns: those of ``FIELDS``, about the run of greatest exponent
    (ties: first start, then period; nulls without a run) and digests of all runs and of the words left when every
    run keeps its first period only; ``with_text`` adds ``runs`` (array of start, length, period) and ``collapsed``
    (those words). ``plant`` makes texts periodic by ``planted``, with a null id as an empty one. A null or empty
    text has no words and no runs. Rows are handled one for one, so repeated rows stay and extra columns pass.
    There is no shuffle: a task holds the words of ``SLICE`` bytes of text, or of one longer text.
    """
    own = {f"{OWN}id": docs[f"`{id_column}`"].cast("string"), f"{OWN}text": docs[f"`{text}`"].cast("string")}
    given = docs.withColumns(own).drop(text)
    plain = [f for f in given.schema if f.name not in own]
    fields = FIELDS | ({"runs": "array<array<bigint>>", "collapsed": "string"} if with_text else {})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in _slices(batches, f"{OWN}id", f"{OWN}text", plant):
            catcher, table = SquareCatcher(min_length, min_exponent), {}
            sizes = np.array([len(w) for w in texts], np.int64)
            catcher.append(numbered([x for w in texts for x in w], table), np.repeat(np.arange(len(texts)), sizes))
            first = np.cumsum(sizes) - sizes
            runs = catcher.runs()
            of = np.searchsorted(first, runs[:, 0], "right") - 1
            by_text: dict[int, list[list[int]]] = {}
            for i, (s, length, p) in zip(of.tolist(), runs.tolist()):
                by_text.setdefault(i, []).append([s - int(first[i]), length, p])
            rows = [_report(w, by_text.get(i, [])) for i, w in enumerate(texts)]
            if with_text:
                for r in rows:
                    r["collapsed"] = b" ".join(r["collapsed"]).decode("utf-8", "replace")
            yield {f.name: batch.column(f.name) for f in plain} | {f"{OWN}{c}": [r[c] for r in rows] for c in fields}

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + [f"{OWN}{c} {t}" for c, t in fields.items()]
    return map_arrow(given, scan, ", ".join(schema))
