"""Phrases that occur together more often than their parts, from sorted streams of counts.

Texts are turned once into slices of numbered words. What may be frequent is found level by level, words first, by
counts of digests, and told to the tasks as bitmaps of fixed size; that only saves work, since whatever may be
frequent is then counted as strings. The frequent phrases are then laid out as
streams in two orders. Sorted by their words from the last to the first, every phrase follows the phrases that it ends
with; sorted from the first to the last, those that it begins with. One pass over each stream, with at most four open
phrases, merges the levels in lockstep: it hands every phrase the counts of its parts and every part the largest
count among its extensions by one word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.base import map_arrow, small_batches
from riskloom.llm.squares import mix
from riskloom.llm.wordstream import SLICE, numbered, texts_of
from riskloom.session import pin

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
COVERED = 80  # per cent of a phrase's occurrences inside a longer one that drop it
UNKNOWN = "und"
BITS_LEAST, BITS_MOST = 1 << 18, 1 << 27  # of the bitmap: 32 kB to 16 MB
BITS_EACH = 16
PROBES = 3  # bits of the bitmap that all must be set for a digest
LOW = 24  # bits of a digest that are kept beside its part
SALTS = 64
FLUSH = 1 << 20  # digests a task holds before it hands them on
HELD = 1 << 19  # phrases a task holds before it hands them on
PART = 1 << 22  # words for each part in which digests and phrases are counted
WORDS = [f"w{k}" for k in range(1, MAX_WORDS + 1)]

_CUT = b"\xff"  # no byte of UTF-8
_FOLD = bytes(
    0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_PAIR = np.uint64(0xA0761D6478BD642F)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; ``_CUT`` stands wherever a piece ends."""
    return text.translate(_FOLD).replace(_CUT, b" \xff ").split()


# A slice: its languages, its words one after the other, for each number the places of its language and its word and its
# count, and the numbers of all words in their order, one more than they are and 0 wherever a piece or text ends.
_SLICES = "langs array<string>, words binary, lang_at binary, word_at binary, counts binary, ids binary"


def _planes(values: np.ndarray, width: int = 4) -> bytes:
    """Numbers of ``width`` bytes as their lowest bytes, then the next ones …: bytes that hardly change lie together and pack well."""
    return np.ascontiguousarray(values.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def _numbers(planes: bytes, width: int = 4) -> np.ndarray:
    flat = np.zeros((len(planes) // width, 4), np.uint8)
    flat[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return flat.view(np.uint32).ravel()


def _digests(langs: list[str], words: list[bytes], lang_at: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    seeds = [xxhash.xxh32_intdigest(x.encode()) for x in langs]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(words[w], seeds[x]) for x, w in zip(lang_at.tolist(), word_at.tolist())], np.uint64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Slices as numbers: ``digests`` of all of theirs, ``ids`` with -1 for ends, and the plain columns."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            row |= {c: _numbers(row[c]).astype(np.int64) for c in ("lang_at", "word_at", "counts", "ids") if c in row}
            row["words"] = row["words"].split(b" ")
            row["digests"] = _digests(row["langs"], row["words"], row["lang_at"], row["word_at"])
            if "ids" in row:
                row["ids"] -= 1
            yield row


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    def slice_of(parts: list[tuple[bytes, list[bytes]]]) -> dict:
        langs = [*dict.fromkeys(lang for lang, _ in parts)]
        code, table = {x: i for i, x in enumerate(langs)}, {_CUT: 0}
        ids = np.concatenate([numbered([*w, _CUT], table) for _, w in parts])
        lang = np.repeat([code[x] for x, _ in parts], [len(w) + 1 for _, w in parts])
        words = [*table]
        keys, names = np.unique(lang * len(words) + ids, return_inverse=True)
        lang_at, word_at = np.divmod(keys, len(words))
        names[word_at[names] == 0] = -1
        return {
            "langs": [[x.decode() for x in langs]], "words": [b" ".join(words)], "lang_at": [_planes(lang_at)], "word_at": [_planes(word_at)],
            "counts": [_planes(np.bincount(names[names >= 0], minlength=len(keys)))], "ids": [_planes(names + 1)],
        }

    parts, held = [], 0
    for batch in batches:
        langs = batch.column("lang").cast(pa.binary()).to_pylist()
        for lang, text in zip(langs, texts_of(batch.column("text"))):
            parts.append((lang, words_of(text)))
            held += len(text)
            if held >= SLICE:
                yield slice_of(parts)
                parts, held = [], 0
    if parts:
        yield slice_of(parts)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for langs, at, counts in zip(*(batch.column(c).to_pylist() for c in ("langs", "lang_at", "counts"))):
            n = np.bincount(_numbers(at), _numbers(counts), len(langs))
            yield {"lang": langs, "n": n.astype(np.int64)}


def _word_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for row in _read(batches):
        some = row["counts"] > 0
        yield row["digests"][some], row["counts"][some]


def _pair_digest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _PAIR + b)


def _places(cut: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bits, of ``size``, of digests cut to what is counted, one probe after the other."""
    for _ in range(PROBES):
        cut = mix(cut)
        yield cut & np.uint64(size - 1)


def _may(bitmap: tuple[np.ndarray, int], digests: np.ndarray) -> np.ndarray:
    """Whether what has these digests may be frequent; never no for what is."""
    bits, kept = bitmap
    out = np.zeros(len(digests), bool)
    some, cut = np.arange(len(digests)), digests & np.uint64(kept)
    for _ in range(PROBES):
        cut = mix(cut)
        at = cut & np.uint64(len(bits) * 8 - 1)
        on = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        some, cut = some[on], cut[on]
    out[some] = True
    return out


def _packed(parts: int, held: list[tuple[np.ndarray, np.ndarray]], min_count: int) -> dict:
    """Digests cut to ``LOW`` bits and a part, each once with its count; counts beyond ``min_count`` say no more than it does.

    The digests of a part are told by their steps, which are small.
    """
    digests = np.concatenate([d for d, _ in held]) & np.uint64((parts << LOW) - 1)
    order = np.argsort(digests)
    digests, counts = digests[order], np.concatenate([c for _, c in held])[order]
    first = np.flatnonzero(np.concatenate([[True], digests[1:] != digests[:-1]]))
    digests, counts = digests[first], np.minimum(np.add.reduceat(counts, first), min_count).astype(np.uint32)
    part = digests >> np.uint64(LOW)
    ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    low, columns, at = digests & np.uint64((1 << LOW) - 1), {"part": [], "low": [], "counts": []}, 0
    for end in ends:
        columns["part"].append(int(part[at]))
        columns["low"].append(zlib.compress(_planes(np.diff(low[at:end], prepend=np.uint64(0)), LOW // 8), 1))
        columns["counts"].append(zlib.compress(_planes(counts[at:end]), 1))
        at = end
    return columns


def _often(min_count: int):
    """Frequent digests of a stream sorted by part."""

    def close(part: int, low: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        digests = np.concatenate(low)
        order = np.argsort(digests)
        digests = digests[order]
        first = np.flatnonzero(np.concatenate([[True], digests[1:] != digests[:-1]]))
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first)
        return (np.int64(part) << np.int64(LOW)) + digests[first[total >= min_count]].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, low, counts = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                part, a, c = (batch.column(n)[i].as_py() for n in ("part", "low", "counts"))
                if part != at and low:
                    yield {"digest": close(at, low, counts)}
                    low, counts = [], []
                at = part
                low.append(np.cumsum(_numbers(zlib.decompress(a), LOW // 8), dtype=np.uint32))
                counts.append(_numbers(zlib.decompress(c)))
        if low:
            yield {"digest": close(at, low, counts)}

    return run


def _bitmap(slices: DataFrame, digests, total: int, min_count: int) -> tuple[np.ndarray, int]:
    """The bitmap of the frequent among the digests that ``digests`` gives for slices, and the bits of a digest that it knows.

    Its size follows their number up to ``BITS_MOST`` and is bounded by it. Digests are counted in parts, whose number
    follows that of all words, so that a part has some ``PART`` entries at most, a quarter of what ``LOW`` bits can tell
    apart; a digest that shares its bits with others may pass as frequent, which costs work and no result.
    """
    parts = 1 << max(0, (total // PART).bit_length())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for found in digests(batches):
            held.append(found)
            size += len(found[0])
            if size >= FLUSH:
                yield _packed(parts, held, min_count)
                held, size = [], 0
        if size:
            yield _packed(parts, held, min_count)

    counted = map_arrow(slices, scan, "part bigint, low binary, counts binary")
    often = pin(map_arrow(counted.repartition("part").sortWithinPartitions("part"), _often(min_count), "digest bigint"))
    size = min(BITS_MOST, max(BITS_LEAST, 1 << (often.count() * BITS_EACH).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in _places(batch.column("digest").to_numpy().astype(np.uint64), size):
                yield {"at": at.astype(np.int64)}

    at = map_arrow(often, places, "at bigint")
    chunks = at.groupBy(F.shiftright("at", 15).alias("chunk")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for row in chunks.collect():  # BITS_MOST at most
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        bits[row["chunk"] * 4096 : row["chunk"] * 4096 + len(part)] = part
    return bits, (parts << LOW) - 1


def _levels(digests: np.ndarray, ids: np.ndarray, bitmaps: list[tuple[np.ndarray, int]], top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For phrases of 1 to ``top`` words: where they start and their digests, wherever both phrases of one word less may be frequent."""
    word = np.append(digests, np.uint64(0))[ids]  # a cut takes the last
    live, at, here = ids >= 0, np.flatnonzero(ids >= 0), word
    for order in range(1, top + 1):
        if order > 1:
            at = np.flatnonzero(live[:-1] & live[1:])
            longer = np.zeros(len(ids), np.uint64)
            longer[at] = _pair_digest(here[at], word[at + order - 1])
            here = longer
        yield order, at, here[at]
        if order <= len(bitmaps):
            live = np.zeros(len(ids), bool)
            live[at[_may(bitmaps[order - 1], here[at])]] = True


def _level_digests(sent, order: int):
    """Digests of the phrases of ``order`` words, with their counts by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for row in _read(batches):
            *_, (_, _, found) = _levels(row["digests"], row["ids"], sent.value, order)
            if len(found):
                yield np.unique(found, return_counts=True)

    return run


def _phrases(slices: DataFrame, bitmaps: list[tuple[np.ndarray, int]], total: int) -> DataFrame:
    """Counts of the phrases of one to ``MAX_WORDS`` words that may be frequent.

    A task adds up some slices and hands on its phrases in order, packed by part: neighbours begin alike and pack well.
    """
    sent = slices.sparkSession.sparkContext.broadcast(bitmaps)
    parts = 1 << max(0, (total // PART).bit_length())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: Counter = Counter()
        for row in _read(batches):
            ids, word = row["ids"], [row["words"][w] for w in row["word_at"].tolist()]
            for order, at, found in _levels(row["digests"], ids, sent.value, MAX_WORDS):
                at = at[_may(sent.value[order - 1], found)]
                grams = ids[at[:, None] + np.arange(order)]
                key = grams[:, 0]
                for column in grams.T[1:]:  # numbers of ever longer heads stay small
                    key = np.unique(key * len(word) + column, return_inverse=True)[1]
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                for phrase, n in zip(_strings(row["langs"], word, row["lang_at"], grams[first]), times.tolist()):
                    held[phrase] += n
            if len(held) >= HELD:
                yield _parted(held, parts)
                held = Counter()
        if held:
            yield _parted(held, parts)

    counted = map_arrow(slices, scan, "part bigint, phrases binary, counts binary")
    counted = map_arrow(counted.repartition("part").sortWithinPartitions("part"), _added, "phrase string, f bigint")
    # Language and phrase are one key; no word has a line break.
    phrase = F.substring_index("phrase", "\n", -1)
    lang = F.expr("left(phrase, length(phrase) - length(substring_index(phrase, '\n', -1)) - 1)")
    words = F.split(phrase, " ")
    return counted.select(lang.alias("lang"), *[F.get(words, F.lit(i)).alias(w) for i, w in enumerate(WORDS)], "f")


def _strings(langs: list[str], word: list[bytes], lang_at: np.ndarray, grams: np.ndarray) -> list[bytes]:
    heads = [x.encode() + b"\n" for x in langs]
    columns = [[word[i] for i in column.tolist()] for column in grams.T]
    joined = columns[0] if len(columns) == 1 else [b" ".join(x) for x in zip(*columns)]
    return [heads[x] + p for x, p in zip(lang_at[grams[:, 0]].tolist(), joined)]


def _parted(held: Counter, parts: int) -> dict:
    """Phrases in their order and their counts, a row for each part that has some."""
    dealt: dict[int, list[bytes]] = {}
    for phrase in sorted(held):
        dealt.setdefault(xxhash.xxh32_intdigest(phrase) & (parts - 1), []).append(phrase)
    return {
        "part": [*dealt], "phrases": [zlib.compress(_CUT.join(x), 1) for x in dealt.values()],
        "counts": [zlib.compress(np.array([held[p] for p in x], np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for x in dealt.values()],
    }


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Phrases and their sums, of a stream sorted by part."""
    at, held = None, Counter()
    for batch in batches:
        for i in range(batch.num_rows):
            part, phrases, counts = (batch.column(n)[i].as_py() for n in ("part", "phrases", "counts"))
            if part != at and held:
                yield _summed(held)
                held = Counter()
            at = part
            times = np.ascontiguousarray(np.frombuffer(zlib.decompress(counts), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
            for phrase, n in zip(zlib.decompress(phrases).split(_CUT), times.tolist()):
                held[phrase] += n
    if held:
        yield _summed(held)


def _summed(held: Counter) -> dict:
    return {"phrase": pa.array([*held], pa.binary()).cast(pa.string()), "f": [*held.values()]}


# A phrase on its way through the streams: its count, the counts of the phrases it ends and begins with (by their
# number of words), and the largest count of an extension by one word.
_PARTS = [f"{side}{k}" for side in "rl" for k in range(1, MAX_WORDS)]
_STREAM = f"lang string, {', '.join(f'{w} string' for w in WORDS)}, f bigint, {', '.join(f'{p} bigint' for p in _PARTS)}, ext bigint, note boolean"
_KEY = ["lang", *WORDS]


def _walk(backwards: bool):
    """One pass over a sorted stream; the open phrases are those that begin (or end) the current one.

    Where an open phrase lies in an earlier partition its count stays null, and what this partition knows of its
    extensions is a row of its own with ``note``: at most ``MAX_WORDS`` of each for a partition's first phrases.
    """
    side = "r" if backwards else "l"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        stack: list[dict] = []  # open phrases, from one word on; each has its words in stream order as ``at``
        lang = None
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                words = tuple(w for c in WORDS if (w := row[c]) is not None)
                at = words[::-1] if backwards else words
                if row["lang"] != lang:
                    done += _close(stack, 0)
                    lang = row["lang"]
                same = 0
                while same < len(stack) and same < len(at) and stack[same]["at"][same] == at[same]:
                    same += 1
                done += _close(stack, same)
                # Levels of the path that have no row here so far.
                while len(stack) < len(at):
                    k = len(stack)
                    blank = dict.fromkeys(_PARTS) | {"lang": lang, "f": None, "ext": None, "note": True, "at": at[: k + 1]}
                    head = at[: k + 1][::-1] if backwards else at[: k + 1]
                    stack.append(blank | {c: head[i] if i <= k else None for i, c in enumerate(WORDS)})
                top = stack[len(at) - 1]
                if row["ext"] is not None:
                    top["ext"] = max(top["ext"] or 0, row["ext"])
                if not row["note"]:
                    top |= {p: row[p] for p in _PARTS if row[p] is not None} | {"f": row["f"], "note": False}
                    for k in range(1, len(at)):
                        top[f"{side}{k}"] = stack[k - 1]["f"]
                    if len(at) > 1:
                        above = stack[len(at) - 2]
                        above["ext"] = max(above["ext"] or 0, row["f"])
            yield _columns(done)
        yield _columns(_close(stack, 0))

    return run


def _close(stack: list[dict], keep: int) -> list[dict]:
    done = [x for x in stack[keep:] if not x["note"] or x["ext"] is not None]
    del stack[keep:]
    return done


def _columns(rows: list[dict]) -> dict:
    return {c: [r[c] for r in rows] for c in [*_KEY, "f", *_PARTS, "ext", "note"]}


_GIVEN = f"array_compact(array({', '.join(WORDS)}))"


def _size() -> Column:
    return F.expr(f"size({_GIVEN})")


def _part(k: int, last: bool) -> dict[str, Column]:
    """The first or last ``k`` words of a phrase, as columns of their own."""
    return {w: F.expr(f"get(slice({_GIVEN}, {-k if last else 1}, {k}), {i})") for i, w in enumerate(WORDS)}


def _along(stream: DataFrame, counts: DataFrame, backwards: bool) -> DataFrame:
    """``stream`` after a pass in one order, with the borders between its partitions mended.

    The stream is cut into ranges of its sort order, so one frequent word may fill many partitions.
    """
    side = "r" if backwards else "l"
    order = ["lang", *([F.expr(f"get(reverse({_GIVEN}), {k})") for k in range(MAX_WORDS)] if backwards else WORDS)]
    dealt = stream.repartitionByRange(*order).sortWithinPartitions(*order, "note")
    out = pin(map_arrow(dealt, _walk(backwards), _STREAM))
    # Parts that lie in an earlier partition: at most MAX_WORDS - 1 a partition, however many rows lack them.
    lacks = {k: ~F.col("note") & (_size() > k) & F.col(f"{side}{k}").isNull() for k in range(1, MAX_WORDS)}
    asked = reduce(DataFrame.unionByName, [
        out.where(lack).select("lang", *[c.alias(w) for w, c in _part(k, backwards).items()]) for k, lack in lacks.items()
    ]).distinct()
    if asked.isEmpty():
        return out
    same = [counts[c].eqNullSafe(asked[c]) for c in _KEY]
    answers = pin(counts.join(F.broadcast(asked), same, "left_semi"))
    for k in lacks:
        known = answers.where(_size() == k).select(*[F.col(c).alias(f"k_{c}") for c in _KEY], F.col("f").alias("k_f"))
        on = [F.col("lang") == F.col("k_lang"), *[c.eqNullSafe(F.col(f"k_{w}")) for w, c in _part(k, backwards).items()], _size() > k, ~F.col("note")]
        out = out.join(F.broadcast(known), on, "left").withColumn(f"{side}{k}", F.coalesce(f"{side}{k}", "k_f")).select(*stream.columns)
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The phrases of two to four words of each language that stand out most: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of its two parts at the cut that makes the score, a / (l + r)
    in units of 1 / 2,000,000, the least; ``n`` counts the words of the language. Phrases under ``min_count`` are no
    candidates; one that occurs to ``covered`` per cent inside a longer candidate is dropped. The first ``top`` of each
    language are given, ties by larger ``a``, then phrase. A null language is ``und``, a null text has no words,
    repeated rows count as often as they occur, other columns are not looked at. Counts are sums of map-side sums;
    the streams are cut by range wherever they are long, and the best are first chosen within parts of a language.
    """
    texts = docs.select(F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[f"`{text}`"].cast("string").alias("text"))
    often = F.col("f") >= min_count
    with small_batches(docs.sparkSession):
        slices = pin(map_arrow(texts, _encode, _SLICES))
        totals = map_arrow(slices.select("langs", "lang_at", "counts"), _totals, "lang string, n bigint")
        totals = pin(totals.groupBy("lang").agg(F.sum("n").alias("n")))
        total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bitmaps = [_bitmap(slices.drop("ids"), _word_digests, total, min_count)]
        for order in range(2, MAX_WORDS + 1):
            sent = docs.sparkSession.sparkContext.broadcast(bitmaps)
            bitmaps = [*bitmaps, _bitmap(slices.drop("counts"), _level_digests(sent, order), total, min_count)]
        counts = pin(_phrases(slices.drop("counts"), bitmaps, total).where(often))
    none = F.lit(None).cast("bigint")
    stream = counts.select(*_KEY, "f", *[none.alias(p) for p in _PARTS], none.alias("ext"), F.lit(False).alias("note"))
    out = _along(_along(stream, counts, True), counts, False)
    notes = out.where("note").groupBy(*[F.col(c).alias(f"n_{c}") for c in _KEY]).agg(F.max("ext").alias("n_ext"))  # at most MAX_WORDS a partition
    found = out.where(~F.col("note") & (_size() > 1))
    found = found.join(F.broadcast(notes), [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in _KEY], "left")
    exact = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  whose products have up to 38 digits
    longest = F.greatest(F.coalesce("ext", F.lit(0)), F.coalesce("n_ext", F.lit(0))).cast("decimal(20,0)")
    found = found.where(longest * 100 < exact("f") * covered)
    # The score of each cut; the least counts, the earliest of equal ones.
    cuts = []
    for k in range(1, MAX_WORDS):
        rest = F.element_at(F.array(*[F.col(f"r{j}") for j in range(1, MAX_WORDS)]), F.greatest(_size() - k, F.lit(1)))
        score = F.call_function("div", exact("f") * 2_000_000, F.col(f"l{k}").cast("decimal(20,0)") + rest.cast("decimal(20,0)"))
        cuts.append(F.when(_size() > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), rest.alias("r"))))
    found = found.withColumn("cut", F.array_min(F.array_compact(F.array(*cuts))))
    found = found.select("lang", F.concat_ws(" ", *WORDS).alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of each part of a language first, so that no task orders all its phrases.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best)
    found = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
