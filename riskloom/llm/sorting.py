"""Suffix arrays by two-stage sorting, on numpy arrays inside one task.

A suffix is *rising* if it is smaller than its successor. Rising suffixes are sorted directly;
all others are induced: their order inside the bucket of a first symbol is the order of their
successors, so scanning the buckets in ascending order yields them without a comparison.
"""

from __future__ import annotations

import numpy as np

# Symbols: 0 ends every segment, a byte b is b + 1.
_WORD = 7  # symbols compared per round of the direct sort


def rising(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is not."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    step = text[1:] != text[:-1]
    # A run of equal symbols takes the direction of the step that ends it.
    at = np.where(step, np.arange(n - 1, dtype=np.int32), n - 1)
    ends = np.minimum.accumulate(at[::-1])[::-1]
    out[:-1] = np.append(text[1:] > text[:-1], False)[ends]
    return out


def _keys(text: np.ndarray, width: int = _WORD) -> np.ndarray:
    """The next ``width`` symbols, seven at most, at every position as one integer."""
    n = len(text)
    padded = np.zeros(n + width, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key <<= np.uint64(9)
        key |= padded[i : i + n]
    return key


def _ranks(text: np.ndarray) -> np.ndarray:
    """The place of the next ``_WORD`` symbols of every position among all of them, from 1."""
    key, span = _keys(text, 7), 7
    while True:
        turn = np.argsort(key)
        ordered = key[turn]
        fresh = np.ones(len(key), np.uint64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.zeros(len(key) + span, np.uint64)  # beyond the end: 0
        rank[turn] = np.cumsum(fresh, dtype=np.uint64)
        if span == _WORD:
            return rank[: len(key)]
        key = (rank[: len(key)] << np.uint64(32)) | rank[span:]
        span *= 2


def _direct_sort(text: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """``which`` in the order of their first ``depth`` symbols at least."""
    n = len(text)
    ranks = _ranks(text) if n else np.zeros(0, np.uint64)
    first = ranks[which]
    turn = np.argsort(first)
    order, first = which[turn], first[turn]
    slots = np.arange(len(order))
    # A group's name is its first slot, so the parts of a split group stay in order.
    fresh = np.concatenate([np.ones(len(order[:1]), bool), first[1:] != first[:-1]])
    of = np.maximum.accumulate(np.where(fresh, slots, 0))
    for at in range(_WORD, depth, _WORD):
        same = of[1:] == of[:-1]
        tied = np.zeros(len(of), bool)
        tied[1:] = same
        tied[:-1] |= same
        slots, of = slots[tied], of[tied]
        if not len(slots):
            break
        rows = order[slots]
        ahead = rows + at
        key = np.where(ahead < n, ranks[np.minimum(ahead, n - 1)], 0) | (of.astype(np.uint64) << np.uint64(32))
        turn = np.argsort(key)
        order[slots], key = rows[turn], key[turn]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        of = np.maximum.accumulate(np.where(fresh, slots, 0))
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` symbols.

    ``text`` holds symbols 0..256. Suffixes equal over ``depth`` symbols stand together in an
    order of no meaning. The empty text gives an empty array.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    up = rising(text)
    # Induction adds one symbol in front, so the direct sort alone decides how deep ties reach.
    direct = _direct_sort(text, np.flatnonzero(up).astype(np.int32), depth)
    symbol_of = text[direct]
    starts = np.searchsorted(symbol_of, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[int(text[n - 1])].append(np.array([n - 1], np.int32))  # its successor is the empty suffix
    out = []

    def induce(block: np.ndarray, symbol: int) -> np.ndarray:
        """Hand the predecessors of ``block`` to their buckets; those of the same symbol are returned."""
        before = block[block > 0] - 1
        before = before[~up[before]]
        first = text[before]
        same = before[first == symbol]
        rest, first = before[first > symbol], first[first > symbol]
        if len(rest):
            turn = np.argsort(first.astype(np.uint16), kind="stable")
            rest, first = rest[turn], first[turn]
            cut = np.flatnonzero(np.diff(first)) + 1
            for part, name in zip(np.split(rest, cut), first[np.concatenate([[0], cut])]):
                waiting[int(name)].append(part)
        return same

    for symbol in range(257):
        block = np.concatenate(waiting[symbol]) if waiting[symbol] else np.zeros(0, np.int32)
        waiting[symbol] = []
        while len(block):  # runs of one symbol, a step longer each time
            out.append(block)
            block = induce(block, symbol)
        block = direct[starts[symbol] : starts[symbol + 1]]
        if len(block):
            out.append(block)
            induce(block, symbol)
    return np.concatenate(out)


def common_prefix(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For neighbours in ``order``: whether they agree on ``length`` symbols without a segment end.

    Entry i tells about order[i] and order[i + 1].
    """
    n = len(text)
    if len(order) < 2:
        return np.zeros(0, bool)
    a, b = order[:-1], order[1:]
    ends = np.where(text == 0, np.arange(n, dtype=np.int32), n)
    room = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n, dtype=np.int32)
    fits = (room[a] >= length) & (room[b] >= length)
    live = np.flatnonzero(fits)
    width = min(7, length)
    keys = _keys(text, width)
    for at in range(0, length, width):
        at = min(at, length - width)  # the last word overlaps rather than runs over
        live = live[keys[a[live] + at] == keys[b[live] + at]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out
