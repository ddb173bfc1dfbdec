"""Periodic runs, collocations and token counts against brute force and against the public library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import collocations as collocation_steps
from riskloom.llm.base import OWN
from riskloom.llm.collocations import collocations
from riskloom.llm.squares import FIELDS, SquareCatcher, periodic_runs
from riskloom.llm.tokens import Merges, TokenCounter, token_counts


def brute_runs(w, min_length=24, exponent=3):
    n, out = len(w), set()
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            part = w[i : j + p]
            if len(part) >= max(min_length, exponent * p):
                q = next(q for q in range(1, p + 1) if all(part[k] == part[k + q] for k in range(len(part) - q)))
                if q == p:
                    out.add((i, len(part), p))
            i = j
    return sorted(out)


def periodic_text(rng):
    n, k = rng.choice([0, 1, 10, 24, 40, 100, 250]), rng.choice([1, 2, 3, 50])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n:
            a, p, length = rng.randrange(n), rng.randrange(1, max(2, n // 3)), rng.randrange(n)
            for i in range(a + p, min(n, a + length)):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least, exponent", [(24, 3), (2, 2), (9, 2), (5, 4)])
def test_runs_at_once_and_word_by_word(least, exponent):
    rng = random.Random(least)
    for _ in range(80):
        w = periodic_text(rng)
        want = brute_runs(w, least, exponent)
        whole, online, i = SquareCatcher(least, exponent), SquareCatcher(least, exponent), 0
        whole.append(np.array(w, np.int64))
        while i < len(w):
            m = rng.choice([1, 1, 2, 7])
            online.append(np.array(w[i : i + m], np.int64))
            i += m
        assert [tuple(r) for r in whole.runs().tolist()] == want
        assert [tuple(r) for r in online.runs().tolist()] == want


def test_a_square_is_reported_when_it_arrives():
    catcher = SquareCatcher()
    caught = [i for i in range(60) if catcher.append(np.array([i % 5]))]
    assert len(caught) >= 1 and caught[0] < 24
    assert [tuple(r) for r in catcher.runs().tolist()] == [(0, 60, 5)]


def test_no_run_reaches_over_two_streams():
    catcher = SquareCatcher()
    catcher.append(np.zeros(40, np.int64), np.repeat([0, 1], 20))
    assert len(catcher.runs()) == 0


def test_runs_of_documents(spark):
    rng = random.Random(5)
    texts = [" \t\n".join(f"w{x}" for x in periodic_text(rng)) for _ in range(120)]
    texts += [None, "", " \n", "a " * 50, "a " * 50, "é\x1cb " * 30]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)] + [(None, "b " * 30, 1), (3, texts[3], 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int").repartition(3)
    got = {(r["doc_id"], r["runs"]): r for r in periodic_runs(docs, plant=True, with_text=True).collect()}
    assert len(got) == len({(a, c) for a, _, c in rows})
    for key, text, extra in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str("" if key is None else key).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        r = got[key, extra]
        assert r[f"{OWN}n_runs"] == len(runs) and [tuple(x) for x in r[f"{OWN}runs"]] == runs
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r[f"{OWN}start"], r[f"{OWN}length"], r[f"{OWN}period"]) == best
        assert r[f"{OWN}exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        assert r[f"{OWN}collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        assert r[f"{OWN}runs_sha256"] == hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest()


def test_runs_of_an_empty_table(spark):
    out = periodic_runs(spark.createDataFrame([], "doc_id bigint, text string"), plant=True)
    assert out.columns == ["doc_id", *[f"{OWN}{c}" for c in FIELDS]] and out.count() == 0


def brute_phrases(rows, least, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\n\x0b\x0c\r":
            lower = lower.replace(mark, "\n")
        for piece in lower.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i : i + m])] += 1
    often = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    out = []
    for lang in total:
        found = []
        for (x, words), a in often.items():
            if x != lang or any(
                y == lang and len(other) > len(words) and 100 * b >= 80 * a
                and any(other[i : i + len(words)] == words for i in range(len(other) - len(words) + 1))
                for (y, other), b in often.items()
            ):
                continue
            cuts = []
            for k in range(1, len(words)):
                p, q = count[lang, words[:k]], count[lang, words[k:]]
                cuts.append((2_000_000 * a // (p + q), k, p, q))
            score, _, p, q = min(cuts)
            found.append((-score, -a, " ".join(words).encode(), p, q))
        for rank, (score, a, phrase, p, q) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, p, q, total[lang], -score))
    return sorted(out)


def phrase_rows():
    rng, rows = random.Random(8), []
    fixed = ["new york", "in spite of", "once upon a time", "of the", "Ça va", "ein und"]
    for i in range(500):
        words = [rng.choice(["of", "the", "a", "in", "x\x01y", "é"] + [f"w{rng.randrange(40)}"] * 3) for _ in range(rng.randrange(30))]
        for _ in range(4):
            words.insert(rng.randrange(len(words) + 1), rng.choice(fixed))
        text = "".join(w + rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "!? "]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([text, text.upper()]) if i % 40 else rng.choice([None, "", "..."])))
    return rows + [("en", "hot hot hot hot hot " * 20)] * 30


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_collocations_against_brute_force(spark, partitions):
    rows = phrase_rows()
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "lang string, text string, f int, w1 string").repartition(4)
        got = sorted(tuple(r) for r in collocations(docs, min_count=12, top=60).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute_phrases(rows, 12, 60)
    assert len(want) > 60 and got == want


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), ("en", ""), ("en", "a b")], "lang string, text string")
    out = collocations(nulls)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_few_rare_phrases_are_counted_as_strings(spark, monkeypatch):
    rng, counted = random.Random(5), []
    words = [f"w{i}" for i in range(400)]
    fixed = [f"w{i} w{(i * 7 + k) % 400}" for i in range(400) for k in (1, 2, 3)]
    rows = [("en", " ".join(rng.choices(words, k=60))) for _ in range(1000)] + [("en", ". ".join(fixed))] * 30
    phrases = collocation_steps._phrases
    monkeypatch.setattr(collocation_steps, "BITS_LEAST", 1 << 15)
    monkeypatch.setattr(collocation_steps, "_phrases", lambda *a: counted.append(phrases(*a)) or counted[0])
    got = sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, "lang string, text string")).collect())
    assert got == brute_phrases(rows, 30, 2000) and len(got) >= 1200
    assert counted[0].where("f < 30").count() * 4 < counted[0].where("f >= 30").count()


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


ODD = [
    "<|endoftext|>", "<|startoftext|>", "a", "é", "é", "Σ", "ς", "İ", "\x1c", "\x85", "\xa0", " ", "　", "​", "漢", "字",
    "한", "ᄒ", "ᅡ", "ᆫ", "😀", "'s", "'LL", "!!", "1", "२", "Ⅷ", "\n", " ", "\t", "\x0b", "\x00", "hello", "WORLD", "ﬁ", "<|", "|>", "ß", "﻿", "Å",
]


def test_tokens_as_the_library_gives_them(vocabulary):
    from tokenizers import Tokenizer

    definition = open(vocabulary, encoding="utf-8").read()
    library, rng = Tokenizer.from_str(definition), random.Random(3)
    counter = TokenCounter(definition, Merges(definition).whole())
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(30)) for _ in range(500)]
    texts += ["ab" * 5000, "supercalifragilistic" * 30, ""]
    for text in texts:
        assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), text


def test_whole_tokens_are_proved(vocabulary):
    from tokenizers import Tokenizer

    merges = Merges(open(vocabulary, encoding="utf-8").read())
    model, whole = Tokenizer.from_file(vocabulary).model, merges.whole()
    ended = [t[: -len(merges.end)] for t in merges.vocabulary if t.endswith(merges.end)]
    assert {w for w in ended if w and len(model.tokenize(w)) == 1} == whole and 0 < len(whole) <= len(ended)


def test_token_counts_of_a_table(spark, small, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "text", "1 AS tokens", "2 AS bytes")
    more = spark.createDataFrame([(-1, None, 0, 0), (-2, "", 0, 0), (-2, "", 0, 0), (None, "x <|endoftext|>", 0, 0), (-3, "a" * 9000 + " b" * 3000, 0, 0)], docs.schema)
    rows = docs.unionByName(more).collect()
    got = Counter(tuple(r) for r in token_counts(docs.unionByName(more), vocabulary).collect())
    want = Counter()
    for r in rows:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"], r["tokens"], r["bytes"], len((r["text"] or "").encode()), n, n > 2048] += 1
    assert got == want
    assert token_counts(docs.where("false"), vocabulary).count() == 0


def test_other_vocabularies_are_refused(vocabulary):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    with pytest.raises(ValueError):
        TokenCounter(definition, frozenset())
