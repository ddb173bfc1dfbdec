"""Classes of all words above a small count, and scores against a plain count of the same model."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import brown
from riskloom.llm.base import OWN


@pytest.fixture()
def families():
    """Texts that change between words of two families; every word stands only before words of the other one."""
    rng = random.Random(3)
    a, b = [f"a{i}" for i in range(40)], [f"bb{i}" for i in range(40)]
    return [" ".join(x for _ in range(rng.randrange(3, 30)) for x in (rng.choice(a), rng.choice(b))) for _ in range(300)]


def test_words_beyond_the_core_join_their_kin(spark, families, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 12)
    monkeypatch.setattr(brown, "PART", 16)
    docs = spark.createDataFrame([(t,) for t in families], "text string").repartition(3)
    counts = brown.map_arrow(docs, brown._count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    model = brown.ClassModel(counts, docs)
    kinds = {w.decode(): int(model.label[i]) for i, w in enumerate(model.lexicon.placed)}
    assert len(kinds) == 81
    of = lambda first: {k for w, k in kinds.items() if w.startswith(first)}
    assert not of("a") & of("b") and max(of("a") | of("b")) < model.lexicon.core


def test_scores_are_those_of_the_model(spark, families, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 12)
    monkeypatch.setattr(brown, "KNOWN", 60)  # some words come by the join
    texts = [*families, "never seen before", None, "", "A0 a0 BB3 unheard"]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id bigint, text string, more_logs double").repartition(3)
    training = F.col("doc_id") % 3 != 0
    body = docs.where(training).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = brown.map_arrow(body, brown._count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    model = brown.ClassModel(counts, body)
    lexicon, label = model.lexicon, model.label
    placed = {w: i for i, w in enumerate(lexicon.placed)}
    kind = lambda w: int(label[placed[w]] if w in placed else label[lexicon.base + brown.shape(w)])
    n, moves, members = Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if i % 3:
            words = brown.tokens((t or "").encode())
            n.update(words)
            moves.update(zip([kind(brown.END), *map(kind, words)], map(kind, words)))
    for w in n:
        members[kind(w)] += 1
    k = int(label.max()) + 1
    out, into = Counter(), Counter()
    for (a, b), c in moves.items():
        out[a] += c
        into[b] += c
    got = {r["doc_id"]: r for r in brown.class_scores(docs, training).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = brown.tokens((t or "").encode())
        want, before = 0.0, kind(brown.END)
        for w in words:
            c = kind(w)
            want += math.log10((moves[before, c] + 1) / (out[before] + k)) + math.log10((n[w] + 1) / (into[c] + members[c] + 1))
            before = c
        assert got[i][f"{OWN}score"] == pytest.approx(want) and got[i]["more_logs"] == 1.5


def test_a_word_stays_where_no_class_is_better():
    rng = np.random.default_rng(0)
    table = rng.integers(1, 50, (6, 6)).astype(float)
    for a in (1, 5):
        out_w, in_w = np.minimum(table[a], 1.0), np.minimum(table[:, a], 1.0)
        best, after = brown.best_class(table, a, out_w, in_w, 0.0, 4)
        assert after.sum() == pytest.approx(table.sum())
        fit = lambda t: (t * np.log(np.maximum(t, 1e-300))).sum() - sum((x * np.log(np.maximum(x, 1e-300))).sum() for x in (t.sum(0), t.sum(1)))
        assert fit(after) >= fit(table) - 1e-9


def test_texts_are_read_twice(spark, families, monkeypatch):
    """To count the words and to write their symbols; every other pass reads symbols."""
    monkeypatch.setattr(brown, "CORE", 12)
    read, plain = [], brown.map_arrow
    monkeypatch.setattr(brown, "map_arrow", lambda df, *a: read.append([c for c in df.columns if c.endswith("text")]) or plain(df, *a))
    docs = spark.createDataFrame([*enumerate(families)], "doc_id bigint, text string").repartition(3)
    assert brown.class_scores(docs, F.col("doc_id") % 3 != 0).count() == len(families)
    assert len(read) > 5 and sum(map(len, read)) == 2
