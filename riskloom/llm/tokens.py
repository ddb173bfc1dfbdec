"""Token counts of texts for a public byte-pair vocabulary that drops white space.

Most words are tokens of the vocabulary themselves. Which vocabulary strings come out of the merges as one token is
proved once, before any text is read; a word that is such a string counts one and is not merged. Only the rest goes
through the merges.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm.base import OWN, map_arrow
from riskloom.llm.wordstream import texts_of

LIMIT = 2048
SHORT = 40  # symbols up to which looking at every pair is quicker than a queue
_NEVER = 1 << 60
REMEMBERED = 1 << 18  # distinct words whose counts a worker keeps; then it starts anew


# Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free one from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + i for i, b in enumerate(sorted({*range(0x100)} - {*_SEEN}))}


class Merges:
    """The merges of a vocabulary file of the ``tokenizers`` library, for words without white space."""

    def __init__(self, definition: str):
        given = json.loads(definition)
        model = given["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)]
        if model.get("type") != "BPE" or odd or model.get("fuse_unk") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-pair vocabulary")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}

    def count(self, word: str) -> int:
        """Tokens of one word in the byte alphabet: the best-ranked pair merges first, the leftmost of equal ones."""
        parts = [*word[:-1], word[-1] + self.end] if word else []
        # A symbol that is not in the vocabulary is left out, as the library does without an unknown token.
        parts = [p for p in parts if p in self.vocabulary]
        n, ranks = len(parts), self.ranks
        if n <= SHORT:
            order = [ranks.get(pair, _NEVER) for pair in zip(parts, parts[1:])]
            while order and (best := min(order)) < _NEVER:
                i = order.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del order[i]
                if i:
                    order[i - 1] = ranks.get((parts[i - 1], parts[i]), _NEVER)
                if i < len(order):
                    order[i] = ranks.get((parts[i], parts[i + 1]), _NEVER)
            return len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        left = n
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get((a + b, parts[k]))) is not None:
                    heapq.heappush(queue, (rank, i, a + b, parts[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get((parts[h], a + b))) is not None:
                heapq.heappush(queue, (rank, h, parts[h], a + b))
        return left

    def whole(self) -> frozenset[str]:
        """The words that encode as one token: every vocabulary string, put through the merges."""
        words = (token[: len(token) - len(self.end)] for token in self.vocabulary if token.endswith(self.end))
        return frozenset(w for w in words if w and self.count(w) == 1)


def _plain_split(given: dict):
    """How the file splits a word of printable Latin characters, where plain Python can do it; else None."""
    normal, split = given.get("normalizer") or {}, given.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    cuts = split.get("pretokenizers", [split])
    # Composition and the folding of white space leave such words alone.
    spaces = [s for s in steps if s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "]
    if [s for s in steps if s["type"] not in ("NFC", "Lowercase") and s not in spaces] or len(cuts) != 2:
        return None
    first, then = cuts
    if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"] or "Regex" not in first["pattern"]:
        return None
    if then != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": then.get("trim_offsets"), "use_regex": False}:
        return None
    found = regex.compile(first["pattern"]["Regex"]).findall
    lower = any(s["type"] == "Lowercase" for s in steps)

    def pieces(word: str) -> list[str]:
        cut = found(word.lower() if lower else word)
        return cut if word.isascii() else [w.encode().decode("latin-1").translate(BYTES) for w in cut]

    return pieces


class TokenCounter:
    """Counts the tokens of texts as the library does, without begin, end or other added tokens."""

    def __init__(self, definition: str, whole: frozenset[str]):
        self.merges, self.whole = Merges(definition), whole
        given = json.loads(definition)
        # Special strings are cut out of the raw text, as by default.
        special = sorted((t["content"] for t in given.get("added_tokens", [])), key=len, reverse=True)
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in given.get("added_tokens", [])):
            raise ValueError("added tokens that are matched otherwise than as they stand are not known here")
        self.special = re.compile("|".join(map(re.escape, special)).encode() or b"(?!)")
        self.opening = [*{s[0].encode() for s in special if s}]
        library = Tokenizer.from_str(definition)
        self.normal = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        if self.split(self.normal(" a \n")) != self.split(self.normal("a")) and [w for w, _ in self.split(self.normal(" a \n"))] != ["a"]:
            raise ValueError("this vocabulary keeps white space; its words cannot be counted apart")
        self.known: dict[bytes, int] = {}
        self.plain = _plain_split(given)
        self.rest: dict[str, int] = {}

    def _pieces(self, part: bytes) -> list[str]:
        text = part.decode("utf-8", "replace")
        # Below this letter nothing composes and lower case does not look at neighbours.
        if self.plain and (text.isascii() or max(text) < "\u0250") and text.isprintable():
            return self.plain(text)
        return [piece for piece, _ in self.split(self.normal(text))]

    def _word(self, word: bytes) -> int:
        """Tokens between two pieces of white space."""
        parts, total = [word], 0
        if any(o in word for o in self.opening):
            parts, total = self.special.split(word), len(self.special.findall(word))
        for part in parts:
            for piece in self._pieces(part) if part else ():
                if piece in self.whole:
                    total += 1
                    continue
                if (n := self.rest.get(piece)) is None:
                    if len(self.rest) >= REMEMBERED:
                        self.rest.clear()
                    n = self.rest[piece] = self.merges.count(piece)
                total += n
        return total

    def count(self, text: bytes) -> int:
        total, known = 0, self.known
        for word in text.split():
            if (n := known.get(word)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[word] = self._word(word)
            total += n
        return total


_COUNTERS: dict[int, TokenCounter] = {}


def _counter(definition: str, whole: frozenset[str]) -> TokenCounter:
    """One counter for all tasks of a worker, so that its remembered words serve them all."""
    key = hash(definition)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(definition, whole)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` without its text, with ``bytes``, ``tokens`` and ``over_limit`` under the prefix ``base.OWN``.

    ``vocabulary`` is the path of a file of the ``tokenizers`` library on the driver; the file and the strings proved to
    be whole tokens are sent to the tasks, so their size is that of the vocabulary. A null text is empty and
    has no tokens. Rows are handled one for one without a shuffle; repeated rows stay and extra columns pass.
    """
    definition = Path(vocabulary).read_text(encoding="utf-8")
    sent = docs.sparkSession.sparkContext.broadcast((definition, Merges(definition).whole()))
    own = f"{OWN}text"
    given = docs.withColumn(own, docs[f"`{text}`"].cast("string")).drop(text)
    plain = [f for f in given.schema if f.name != own]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counter = _counter(*sent.value)
        for batch in batches:
            sizes, tokens = [], []
            for raw in texts_of(batch.column(own)):
                sizes.append(len(raw))
                tokens.append(counter.count(raw))
            yield {f.name: batch.column(f.name) for f in plain} | {f"{OWN}bytes": sizes, f"{OWN}tokens": tokens}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    out = map_arrow(given, scan, f"{schema}{', ' if schema else ''}{OWN}bytes bigint, {OWN}tokens bigint")
    return out.withColumn(f"{OWN}over_limit", F.col(f"{OWN}tokens") > limit)
