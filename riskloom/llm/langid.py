"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads windows of ``WINDOW`` bytes from both ends, labels every position, and the label
probabilities of all positions of a text are averaged. It is trained in numpy by backpropagation
through time on a bounded sample of labelled rows; prediction reads every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import OWN, map_arrow

WINDOW = 128
HIDDEN = 8
TRAIN_DOCS = 400  # labelled texts of each language, about: drawn by hash of the text
TRAIN_WINDOWS = 4  # windows of each of them, evenly spaced
EPOCHS = 5
BATCH = 128
RATE = 0.01
BLOCK = 2048  # windows read at once


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.negative(x)
    np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


def _tanh(x: np.ndarray) -> np.ndarray:
    y = _sigmoid(2 * x)
    y *= 2
    y -= 1
    return y


class Direction:
    """One gated recurrent layer; reset, update and candidate gates lie below each other.

    Arrays are hidden x windows, so that elementwise work runs along many windows.
    """

    def __init__(self, rng: np.random.Generator) -> None:
        scale = 1 / np.sqrt(HIDDEN)
        self.params = {
            "byte": rng.normal(0, 0.1, (3 * HIDDEN, 256)).astype(np.float32),
            "state": rng.uniform(-scale, scale, (3 * HIDDEN, HIDDEN)).astype(np.float32),
            "bias": np.zeros((3 * HIDDEN, 1), np.float32),
        }

    def forward(self, x: np.ndarray, keep: np.ndarray | None, trace: list | None = None) -> np.ndarray:
        """States after each step: time x hidden x windows. ``keep`` is 0 where a window has ended."""
        byte, state = self.params["byte"], self.params["state"]
        bias, two = self.params["bias"], 2 * HIDDEN
        h = np.zeros((HIDDEN, x.shape[1]), byte.dtype)
        out = np.empty((len(x), HIDDEN, x.shape[1]), byte.dtype)
        for t in range(len(x)):
            given = byte.take(x[t], axis=1)
            own = state @ h
            own += bias
            given[:two] += own[:two]
            gates = _sigmoid(given[:two])
            r, z = gates[:HIDDEN], gates[HIDDEN:]
            n = _tanh(given[two:] + r * own[two:])
            if trace is not None:
                trace.append((h, r, z, n, own[two:]))
            h = n + z * (h - n)
            if keep is not None:
                h *= keep[t]
            out[t] = h
        return out

    def backward(self, x: np.ndarray, trace: list, up: np.ndarray, keep: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, given those of the states."""
        grads = {k: np.zeros_like(v) for k, v in self.params.items()}
        state = self.params["state"]
        back = np.zeros_like(up[0])
        for t in range(len(x) - 1, -1, -1):
            h, r, z, n, cand = trace[t]
            d = (up[t] + back) * keep[t]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * cand * r * (1 - r)
            given = np.concatenate([dr, dz, dn])
            own = np.concatenate([dr, dz, dn * r])
            grads["byte"] += given @ np.equal(x[t][:, None], np.arange(256)).astype(given.dtype)
            grads["state"] += own @ h.T
            grads["bias"] += own.sum(axis=1, keepdims=True)
            back = d * z + state.T @ own
        return grads


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the middle axis, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


class ByteTagger:
    def __init__(self, labels: list[str], seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.behind = Direction(rng), Direction(rng)
        self.top = {
            "w": rng.normal(0, 0.1, (len(labels), 2 * HIDDEN)).astype(np.float32),
            "b": np.zeros((len(labels), 1), np.float32),
        }

    def _states(self, x: np.ndarray, keep: np.ndarray | None, traces=(None, None)) -> tuple[np.ndarray, np.ndarray]:
        ahead = self.ahead.forward(x, keep, traces[0])
        return ahead, self.behind.forward(x[::-1], None if keep is None else keep[::-1], traces[1])[::-1]

    def _positions(self, states: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        w = self.top["w"]
        return _softmax(w[:, :HIDDEN] @ states[0] + w[:, HIDDEN:] @ states[1] + self.top["b"])

    def positions(self, x: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        """Label probabilities at each position: time x labels x windows."""
        return self._positions(self._states(x, keep))

    def gradients(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray) -> tuple[float, list[dict]]:
        """Mean cross-entropy over the positions, and its gradients for both directions and the top."""
        traces: tuple[list, list] = ([], [])
        states = self._states(x, keep, traces)
        d = self._positions(states)
        count = max(float(keep.sum()), 1.0)
        windows = np.arange(len(y))
        loss = float(-(np.log(d[:, y, windows] + 1e-12) * keep).sum() / count)
        d[:, y, windows] -= 1
        d *= (keep / count)[:, None, :]
        both = np.concatenate(states, axis=1)
        top = {"w": np.einsum("tlb,thb->lh", d, both, optimize=True), "b": d.sum(axis=(0, 2))[:, None]}
        up = self.top["w"].T @ d
        ahead = self.ahead.backward(x, traces[0], up[:, :HIDDEN], keep)
        behind = self.behind.backward(x[::-1], traces[1], up[::-1, HIDDEN:], keep[::-1])
        return loss, [ahead, behind, top]

    def fit(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> ByteTagger:
        """Adam over shuffled batches; ``x`` and ``keep`` are windows x time."""
        rng = np.random.default_rng(seed)
        stores = [self.ahead.params, self.behind.params, self.top]
        m = [{k: np.zeros_like(v) for k, v in s.items()} for s in stores]
        v = [{k: np.zeros_like(w) for k, w in s.items()} for s in stores]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                _, grads = self.gradients(np.ascontiguousarray(x[rows].T), np.ascontiguousarray(keep[rows].T), y[rows])
                step += 1
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for store, ms, vs, gs in zip(stores, m, v, grads):
                    for k, g in gs.items():
                        ms[k] += 0.1 * (g - ms[k])
                        vs[k] += 0.001 * (g * g - vs[k])
                        store[k] -= (rate * ms[k] / (np.sqrt(vs[k]) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over all positions of each text; zeros for an empty one."""
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        grid = np.zeros(int(windows.sum()) * WINDOW, np.uint8)
        starts = (np.cumsum(windows) - windows) * WINDOW
        for s, n, t in zip(starts.tolist(), sizes.tolist(), texts):
            grid[s : s + n] = np.frombuffer(t, np.uint8)
        grid = grid.reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        left = np.minimum(WINDOW, sizes[owner] - (np.arange(len(grid)) - (starts // WINDOW)[owner]) * WINDOW)
        sums = np.zeros((len(texts), len(self.labels)))
        # Whole windows need no mask, so they are read apart from the ends of the texts.
        for whole in (True, False):
            chosen = np.flatnonzero((left == WINDOW) == whole)
            for at in range(0, len(chosen), BLOCK):
                rows = chosen[at : at + BLOCK]
                keep = None if whole else (np.arange(WINDOW)[:, None] < left[rows]).astype(np.float32)
                p = self.positions(np.ascontiguousarray(grid[rows].T), keep)
                if keep is not None:
                    p *= keep[:, None, :]
                np.add.at(sums, owner[rows], p.sum(axis=0).T)
        return sums / np.maximum(sizes, 1)[:, None]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        lang, piece = [], []
        for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            last = max(0, len(text) - WINDOW)
            for at in sorted({last * i // max(1, TRAIN_WINDOWS - 1) for i in range(TRAIN_WINDOWS)}):
                lang.append(name)
                piece.append(text[at : at + WINDOW])
        yield {"lang": lang, "piece": piece}


def train_tagger(labelled: DataFrame) -> ByteTagger | None:
    """A network for the non-null values of ``lang``, learnt from about ``TRAIN_DOCS`` rows of ``text`` each."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    names = sorted(counts)
    share = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, TRAIN_DOCS / counts[n])))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003
    sample = map_arrow(labelled.where(draw), _windows, "lang string, piece binary").toArrow()
    rows = sorted(zip(sample.column("lang").to_pylist(), sample.column("piece").to_pylist()))
    x = np.zeros((len(rows), WINDOW), np.uint8)
    keep = np.zeros((len(rows), WINDOW), np.float32)
    for i, (_, piece) in enumerate(rows):
        x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        keep[i, : len(piece)] = 1
    y = np.array([names.index(n) for n, _ in rows], np.int64)
    return ByteTagger(names).fit(x, keep, y)


def predict_language(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` under the prefix ``base.OWN``.

    Learns from rows where ``training`` holds and ``lang`` is not null. ``lang_pred`` is the label of the
    largest mean probability (the first in order on ties) and ``score`` that mean; a null text or one
    without a letter gives ``und`` and 0, as does every text if nothing can be learnt. Every row stays.
    """
    body, tag = docs[f"`{text}`"].cast("string"), docs[f"`{lang}`"].cast("string")
    lettered = F.coalesce(body.rlike(r"\p{L}"), F.lit(False))
    tagger = train_tagger(docs.where(training & tag.isNotNull() & lettered).select(body.alias("text"), tag.alias("lang")))
    read = f"{OWN}read"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column(read).cast(pa.binary()).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None] if tagger else []
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                p = tagger.documents([texts[i] for i in known])
                for i, row in zip(known, p):
                    best = int(row.argmax())
                    pred[i], score[i] = tagger.labels[best], float(min(1.0, row[best]))
            yield {n: batch.column(n) for n in batch.schema.names if n != read} | {f"{OWN}lang_pred": pred, f"{OWN}score": score}

    given = docs.withColumn(read, F.when(lettered, body))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(given, run, f"{schema}, {OWN}lang_pred string, {OWN}score double")
