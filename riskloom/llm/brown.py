"""Class-based bigram scores of texts: words in classes by exchange, transitions between classes.

The log probability of a text is the sum over its tokens of log P(class | class before) and
log P(word | class). Words seen often enough get their class by exchange on the class bigrams of all training texts:
the most frequent ones one after the other, then all of them at once, each choosing its best class from its own counts of
classes before and after it, in parts that run side by side. Every other word has a fixed class by the band of its
length and last letter, known from the word alone, and its own corpus count. Word counts are a plain word count
over the corpus, and the counts of rare words reach the texts by a join, so nothing grows on the driver.

Texts are read twice: to count their words, and to write them as symbols. All passes after that read symbols. Every text
ends with the end, which also stands before every first word, so symbols of many texts are one stream.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import OWN, map_arrow
from riskloom.llm.wordstream import texts_of
from riskloom.session import pin

PLACED = 10  # occurrences from which a word gets a class by exchange
CORE = 2000  # most frequent words that are placed one after the other, which gives the classes
ROUNDS = 2  # times that all placed words choose their class side by side
PART = 1024  # words of a part that chooses
CLASSES = 48  # classes of placed words
SHAPES = 16  # classes of all other words
SWEEPS = 4  # passes of the exchange
KNOWN = 200_000  # words whose counts and classes every task holds, at most; the counts of all others are joined
CONTEXTS = 1_000_000  # tokens whose neighbours' classes are counted at once
END = b"\n"  # the end token, which no word equals
FLUSH = 400_000  # distinct words or pairs held before a task hands them on


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words between ASCII white space, then the end."""
    words = text.lower().split()
    words.append(END)
    return words


def shape(word: bytes) -> int:
    """Class, from 0 to ``SHAPES`` - 1, of a word that clustering has not placed."""
    return (min(len(word), 15) // 4) * 4 + (word[-1] & 3)


def word_name(word: bytes) -> int:
    """What Spark's ``xxhash64`` gives for the word."""
    x = xxhash.xxh64_intdigest(word, 42)
    return x - (1 << 64) if x >> 63 else x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            seen.update(tokens(text))
            if len(seen) >= FLUSH:
                yield {"word": [*seen], "n": [*seen.values()]}
                seen.clear()
    if seen:
        yield {"word": [*seen], "n": [*seen.values()]}


class Lexicon:
    """The most frequent words, ``KNOWN`` at most, with their counts and symbols.

    Symbols number the end and the words seen ``PLACED`` times, then the shapes of all other words.
    """

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.placed = [END, *(w for w, n in zip(words, counts) if n >= PLACED and w != END)]
        self.core = min(len(self.placed), CORE + 1)
        self.base = len(self.placed)
        self.size = self.base + SHAPES
        number = {w: i for i, w in enumerate(self.placed)}
        self.index = {w: i for i, w in enumerate(words)}
        self.symbol = np.array([number[w] if w in number else self.base + shape(w) for w in words], np.int64)
        self.counts = np.array(counts, np.int64)
        self.end = 0
        # The symbols of a smaller lexicon of the core words and the shapes of all others.
        shapes = [self.core + shape(w) for w in self.placed[self.core :]]
        self.to_core = np.concatenate([np.arange(self.core), shapes, self.core + np.arange(SHAPES)]).astype(np.int64)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, list[int], np.ndarray]:
        """Places in the lexicon, the positions of words not in it, and the symbols of all."""
        get = self.index.get
        at = np.array([get(w, -1) for w in words], np.int64)
        symbols = self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int64)
        missing = np.flatnonzero(at < 0).tolist()
        for i in missing:
            symbols[i] = self.end if words[i] == END else self.base + shape(words[i])
        return at, missing, symbols


def _packed(symbols: np.ndarray, size: int) -> bytes:
    return symbols.astype(np.uint16 if size <= 1 << 16 else np.uint32).tobytes()


def _streams(lexicon: Lexicon, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """The symbols of whole texts one after the other, the end before them; some ``most`` at once, a longer text alone."""
    kind = np.uint16 if lexicon.size <= 1 << 16 else np.uint32
    held, total = [np.array([lexicon.end], kind)], 0
    for batch in batches:
        for raw in batch.column(f"{OWN}symbols"):
            found = np.frombuffer(raw.as_py(), kind)
            held.append(found)
            total += len(found)
            if total >= most:
                yield np.concatenate(held).astype(np.int64)
                held, total = held[:1], 0
    if total:
        yield np.concatenate(held).astype(np.int64)


def _bigrams(lexicon: Lexicon, kinds: np.ndarray, size: int):
    """Pairs of neighbouring ``kinds`` of symbols; the end of a text also stands before its first word."""

    def run(batches):
        for stream in _streams(lexicon, batches, 4_000_000):
            found = kinds[stream]
            n = np.bincount(found[:-1] * size + found[1:])  # (CORE + SHAPES + 1) ** 2 cells at most
            pair = np.flatnonzero(n)
            yield {"pair": pair, "n": n[pair]}

    return run


def _contexts(lexicon: Lexicon, label: np.ndarray, classes: int):
    """How often each placed word stands before and after each class, by parts of ``PART`` words; behind it, with itself."""
    width = 2 * classes + 1

    def flush(keys: np.ndarray) -> dict:
        key, n = np.unique(keys.astype(np.int32) if lexicon.base * width < 1 << 31 else keys, return_counts=True)
        key = key.astype(np.int64)
        part = key // (PART * width)
        ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        pieces = list(zip(ends, ends[1:]))
        return {
            "part": [int(part[i]) for i, _ in pieces], "key": [(key[i:j] % (PART * width)).astype(np.int32).tobytes() for i, j in pieces],
            "n": [n[i:j].astype(np.int32).tobytes() for i, j in pieces],
        }

    def run(batches):
        for symbols in _streams(lexicon, batches, CONTEXTS):
            kinds = label[symbols]
            first, second = symbols[:-1], symbols[1:]
            after, before = first < lexicon.base, second < lexicon.base
            same = after & (first == second)
            yield flush(np.concatenate([
                first[after] * width + kinds[1:][after], second[before] * width + classes + kinds[:-1][before], first[same] * width + 2 * classes,
            ]))

    return run


def _choose(label: np.ndarray, table: np.ndarray, k: int, placed: int):
    """The best class of each word of a part, all other words staying where they are."""
    classes = len(table)
    width = 2 * classes + 1

    def close(part: int, counts: np.ndarray) -> dict:
        words = np.flatnonzero(counts.any(1))
        words = words[part * PART + words < placed]
        found = []
        for w in words.tolist():
            row, own = counts[w].astype(np.float64), int(label[part * PART + w])
            found.append(best_class(table, own, row[:classes], row[classes : 2 * classes], row[-1], k)[0])
        return {"symbol": part * PART + words, "class": found}

    def run(batches):
        at, counts = None, np.zeros((PART, width), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                part, key, n = (batch.column(c)[i].as_py() for c in ("part", "key", "n"))
                if part != at and at is not None:
                    yield close(at, counts)
                    counts[:] = 0
                at = part
                counts.ravel()[np.frombuffer(key, np.int32)] += np.frombuffer(n, np.int32)  # a key once a row
        if at is not None:
            yield close(at, counts)

    return run


def _gain(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_class(table: np.ndarray, a: int, out_w: np.ndarray, in_w: np.ndarray, self_pairs: float, k: int) -> tuple[int, np.ndarray]:
    """The class below ``k`` that most raises the class bigram likelihood for a word now in ``a``, and the table without it.

    ``out_w`` and ``in_w`` count the classes after and before the word, itself in its class included. Ties stay where they are.
    """
    out_w, in_w = out_w.copy(), in_w.copy()
    out_w[a] -= self_pairs
    in_w[a] -= self_pairs
    base = table.copy()
    base[a] -= out_w
    base[:, a] -= in_w
    base[a, a] -= self_pairs
    # What the word adds as a neighbour of a class does not depend on its own class.
    rows, cols = base.sum(axis=1) + in_w, base.sum(axis=0) + out_w
    choice = np.append(np.arange(k), a) if a >= k else np.arange(k)
    cells = _gain(base)
    # Likelihood: cells minus row and column totals; only row, column and corner of the target change.
    with_row = _gain(base[choice] + out_w[None, :]) - cells[choice]
    with_col = (_gain(base[:, choice] + in_w[:, None]) - cells[:, choice]).T
    span = np.arange(len(choice))
    corner = _gain(base[choice, choice] + out_w[choice] + in_w[choice] + self_pairs) - cells[choice, choice]
    score = with_row.sum(axis=1) + with_col.sum(axis=1) + corner - with_row[span, choice] - with_col[span, choice]
    score -= _gain(rows[choice] + out_w.sum() + self_pairs) - _gain(rows[choice])
    score -= _gain(cols[choice] + in_w.sum() + self_pairs) - _gain(cols[choice])
    b = int(np.argmax(score > score.max() - 1e-9))
    own = int(np.flatnonzero(choice == a)[0])
    best = a if score[b] <= score[own] + 1e-9 else int(choice[b])
    base[best] += out_w
    base[:, best] += in_w
    base[best, best] += self_pairs
    return best, base


def exchange(pairs: np.ndarray, counts: np.ndarray, frequent: int, size: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol: frequent ones move to the class that most raises the class bigram likelihood.

    The last symbols keep classes of their own after the others. Ties stay with the smaller class.
    """
    own = np.zeros((size, size), np.float64)
    own[pairs // size, pairs % size] = counts
    total = own.sum(axis=1) + own.sum(axis=0)
    fixed = size - frequent
    k = min(classes, max(1, frequent))
    label = np.concatenate([np.arange(frequent) % k, k + np.arange(fixed)])
    n = k + fixed
    hot = np.zeros((size, n))
    hot[np.arange(size), label] = 1
    table = hot.T @ own @ hot
    right, left = own @ hot, own.T @ hot  # bigrams of each symbol with each class after and before it

    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-total[:frequent], kind="stable"):
            a = label[w]
            b, table = best_class(table, a, right[w], left[w], own[w, w], k)
            if b != a:
                moved += 1
                label[w] = b
                right[:, a] -= own[:, w]
                right[:, b] += own[:, w]
                left[:, a] -= own[w]
                left[:, b] += own[w]
        if not moved:
            break
    return label


def _frequent(counts: DataFrame) -> tuple[list[bytes], list[int]]:
    """The words of the largest counts, most frequent first: whole bands of equal counts, as many as ``KNOWN`` holds.

    The least count is found from the number of words in each band of a sixty-fourth of a power of two.
    """
    band = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    taken, least = 0, None
    for r in sorted(counts.groupBy(band.alias("b")).agg(F.count("*").alias("w"), F.min("n").alias("n")).collect(), reverse=True):
        taken += r["w"]
        if taken > KNOWN:
            break
        least = r["n"]
    if least is None:
        return [], []
    head = counts.where(F.col("n") >= least).toArrow()
    pairs = sorted(zip(head.column("n").to_pylist(), map(bytes, head.column("word").to_pylist())), key=lambda x: (-x[0], x[1]))
    return [w for _, w in pairs], [n for n, _ in pairs]


class ClassModel:
    """Classes, transitions and class sizes: bounded by ``KNOWN``, ``CLASSES`` and ``SHAPES``."""

    def __init__(self, counts: DataFrame, training: DataFrame, lexicon: Lexicon | None = None) -> None:
        """``training`` holds texts, or, with the ``lexicon`` of their symbols, what ``_encode`` made of them."""
        if lexicon is None:
            lexicon = Lexicon(*_frequent(counts))
            texts = training.select(F.col("text").alias(f"{OWN}text"))
            training = pin(map_arrow(texts, _encode(lexicon), _CODES).select(f"{OWN}symbols"))
        core, base = lexicon.core, lexicon.base
        pairs, n = self._pairs(training, lexicon, lexicon.to_core, core + SHAPES)
        small = exchange(pairs, n, core, core + SHAPES)
        k = int(small[:core].max()) + 1
        classes = k + SHAPES
        small = np.concatenate([small[:core], k + np.arange(SHAPES)])
        label = small[lexicon.to_core]  # words beyond the core begin with their shape
        table = np.zeros((classes, classes))  # of these labels, without another pass
        np.add.at(table, (small[pairs // (core + SHAPES)], small[pairs % (core + SHAPES)]), n)
        for _ in range(ROUNDS if base > core else 0):
            seen = map_arrow(training, _contexts(lexicon, label, classes), "part bigint, key binary, n binary")
            chosen = map_arrow(seen.repartition("part").sortWithinPartitions("part"), _choose(label, table, k, base), "symbol bigint, class bigint").toArrow()
            label[chosen.column("symbol").to_numpy()] = chosen.column("class").to_numpy()
            table = self._table(training, lexicon, label, classes)
        # Distinct words by shape over the corpus; placed words count in their own class instead.
        last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int").bitwiseAND(3)
        band = F.floor(F.least(F.octet_length("word"), F.lit(15)) / 4).cast("int")
        distinct = np.zeros(classes)
        for s, v in counts.groupBy((band * 4 + last).alias("s")).agg(F.count("*").alias("v")).collect():
            distinct[label[base + s]] += v
        for i, w in enumerate(lexicon.placed):
            if w in lexicon.index:
                distinct[label[base + shape(w)]] -= 1
                distinct[label[i]] += 1
        self.lexicon, self.label = lexicon, label
        # Add-one: every transition has a probability, and every class room for one unseen word.
        self.log_move = np.log10((table + 1) / (table.sum(axis=1, keepdims=True) + classes))
        self.log_class = np.log10(table.sum(axis=0) + distinct + 1)

    @staticmethod
    def _pairs(training: DataFrame, lexicon: Lexicon, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        seen = map_arrow(training, _bigrams(lexicon, kinds, size), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        return seen.column("pair").to_numpy(), seen.column("n").to_numpy()

    def _table(self, training: DataFrame, lexicon: Lexicon, label: np.ndarray, classes: int) -> np.ndarray:
        """Class bigrams of the training texts."""
        pairs, n = self._pairs(training, lexicon, label, classes)
        table = np.zeros((classes, classes))
        table[pairs // classes, pairs % classes] = n
        return table


_CODES = f"{OWN}n bigint, {OWN}hits bigint, {OWN}logs double, {OWN}rare array<bigint>, {OWN}times array<bigint>, {OWN}symbols binary"


def _encode(lexicon: Lexicon):
    """Per text: its symbols, the part of its base score known here, and the words whose counts are elsewhere."""
    log_count = np.log10(lexicon.counts + 1)

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n", "hits", "logs", "rare", "times", "symbols")}
            for text in texts_of(batch.column(f"{OWN}text")):
                words = tokens(text)
                at, missing, symbols = lexicon.read(words)
                rare = Counter([word_name(words[i]) for i in missing])
                out["n"].append(len(words))
                out["hits"].append(len(words) - len(missing))
                out["logs"].append(float(log_count[at[at >= 0]].sum()))
                out["rare"].append([*rare])
                out["times"].append([*rare.values()])
                out["symbols"].append(_packed(symbols, lexicon.size))
            yield {n: batch.column(n) for n in batch.schema.names if n != f"{OWN}text"} | {f"{OWN}{k}": v for k, v in out.items()}

    return run


def _score(model: ClassModel):
    """Per text of symbols: the log probability of its classes, and of each word within its class but for the word's count."""
    label, start = model.label, model.lexicon.end
    kind = np.uint16 if model.lexicon.size <= 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            path = []
            for raw in batch.column(f"{OWN}symbols"):
                kinds = label[np.append(start, np.frombuffer(raw.as_py(), kind)).astype(np.int64)]
                path.append(float((model.log_move[kinds[:-1], kinds[1:]] - model.log_class[kinds[1:]]).sum()))
            yield {n: batch.column(n) for n in batch.schema.names if n != f"{OWN}symbols"} | {f"{OWN}path": path}

    return run


def class_scores(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its token counts and scores under the prefix ``base.OWN``.

    ``training`` marks the rows to learn from; null counts as false. Added: ``n_tokens``, ``n_known``
    (tokens of words seen in training), ``train_tokens``, ``base_score`` (add-one unigram) and ``score``
    (log10 probability by the class model; ``10 ** (-score / n_tokens)`` is the perplexity). A null or
    empty text is its end token alone. Without training rows every word is unseen. Every row stays.
    """
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    learn = docs.where(training).select(body.alias("text"))
    counts = pin(map_arrow(learn, _count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lexicon = Lexicon(*_frequent(counts))
    marked = docs.withColumns({f"{OWN}text": body, f"{OWN}learn": F.coalesce(training, F.lit(False))})
    given = marked.drop(text).withColumn(f"{OWN}row", F.monotonically_increasing_id())
    fields = lambda df, *off: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in off)
    # Pinned, so that row numbers are given once.
    coded = pin(map_arrow(given, _encode(lexicon), f"{fields(given, f'{OWN}text')}, {_CODES}"))
    model = ClassModel(counts, coded.where(f"{OWN}learn").select(f"{OWN}symbols"), lexicon)
    scored = coded.drop(f"{OWN}learn", f"{OWN}rare", f"{OWN}times")
    parts = map_arrow(scored, _score(model), f"{fields(scored, f'{OWN}symbols')}, {OWN}path double")
    zipped = F.explode(F.arrays_zip(F.col(f"{OWN}rare").alias("rare"), F.col(f"{OWN}times").alias("times")))
    rare = coded.select(f"{OWN}row", zipped.alias("z")).select(f"{OWN}row", "z.rare", "z.times")
    named = counts.select(F.xxhash64("word").alias("rare"), F.log10(F.col("n") + 1).alias("log"))
    joined = rare.join(named, "rare").groupBy(f"{OWN}row").agg(
        F.sum(F.col("times") * F.col("log")).alias(f"{OWN}more_logs"), F.sum("times").alias(f"{OWN}more_hits")
    )
    out = parts.join(joined, f"{OWN}row", "left")
    logs = F.col(f"{OWN}logs") + F.coalesce(f"{OWN}more_logs", F.lit(0.0))
    return out.withColumns({
        f"{OWN}n_tokens": F.col(f"{OWN}n"),
        f"{OWN}n_known": F.col(f"{OWN}hits") + F.coalesce(f"{OWN}more_hits", F.lit(0)),
        f"{OWN}train_tokens": F.lit(n).cast("long"),
        f"{OWN}base_score": logs - F.col(f"{OWN}n") * F.log10(F.lit(float(n + v + 1))),
        f"{OWN}score": logs + F.col(f"{OWN}path"),
    }).drop(*[f"{OWN}{c}" for c in ("row", "n", "hits", "logs", "path")], f"{OWN}more_logs", f"{OWN}more_hits")
