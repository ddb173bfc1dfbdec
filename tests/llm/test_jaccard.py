"""The near-duplicate stage against brute force over all pairs of word shingles."""

import random

import numpy as np
import pyarrow as pa

from riskloom.llm import jaccard
from riskloom.llm.base import OWN
from riskloom.llm.stages import one_of_each_group


def brute(texts):
    def sets(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    found = [sets(t) for t in texts]
    label = [*range(len(texts))]
    near = [
        (i, j) for i, a in enumerate(found) for j, b in enumerate(found[:i])
        if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b))
    ]
    for _ in texts:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return label


def edited(rng, words, edits):
    words = [*words]
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def sample():
    rng = random.Random(5)
    texts = [None, "", "  ", "few words", "Few  words", "few words more"]
    for k in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((60, 200, 800)))]
        texts.append(" ".join(base))
        texts += [edited(rng, base, max(1, len(base) * e // 100)) for e in (1, 1, 2, 2, 3, 4)]
    chain = [f"c{i}" for i in range(300)]
    for _ in range(6):  # each near the one before, the last far from the first
        chain = chain[8:] + [f"x{rng.random()}" for _ in range(8)]
        texts.append(" ".join(chain))
    return texts


def test_groups_are_those_of_all_pairs(spark):
    texts = sample()
    got = jaccard.similar_texts(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"))
    assert {r["doc_id"]: r[f"{OWN}component"] for r in got.collect()} == dict(enumerate(brute(texts)))


def test_stage_keeps_one_of_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    copy = " ".join(w if i not in (40, 120, 200, 280) else "other" for i, w in enumerate(words))  # similarity 0.87
    far = " ".join(w if i % 20 else "other" for i, w in enumerate(words))  # below 0.8
    rows = [(3, copy), (1, " ".join(words)), (2, far), (None, copy + " and"), (None, "no id at all"), (None, "no id  at ALL")]
    out = one_of_each_group(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(((r["doc_id"] or 0) for r in out.collect())) == [0, 1, 2]


def test_stage_verifies_what_simhash_links(spark, monkeypatch):
    """Every text's fingerprint is linked by the operator, and one row of what is linked and similar stays."""
    words = [f"w{i}" for i in range(600)]
    near = " ".join([*words, "end"])
    texts = [" ".join(words), near, "one text of its own", None]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    given, linked = [], []
    edges, verified = jaccard.near_edges, jaccard._verified
    monkeypatch.setattr(jaccard, "near_edges", lambda values: given.extend(r[0] for r in values.collect()) or edges(values))
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets: linked.append(pairs.count()) or verified(pairs, sets))
    out = one_of_each_group(spark, rows, "")
    assert sorted(given) == sorted(jaccard.fingerprint((t or "").encode(), 5) for t in texts)
    assert linked[0] == 1
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]


def test_empty_table(spark):
    assert jaccard.similar_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_texts_of_a_template_do_not_meet_by_what_some_share(spark):
    """Sixteen of a hundred shingles are beside the template, each in several texts: no pair can reach 0.8."""
    sets = []
    for i in range(60):
        own = [10_000 + 100 * (i // 4) + j for j in range(4)] + [20_000 + 100 * i + j for j in range(12)]
        sets.append((i, np.unique(np.array([*range(84), *own], np.uint64)).tobytes()))
    table = spark.createDataFrame(sets, "fp bigint, shingles binary")
    texts = spark.createDataFrame([(i, 100, i) for i in range(60)], "fp bigint, size int, root bigint")
    assert jaccard._by_rarest(texts, table).count() == 0
    near = [(i, np.array([*range(i, i + 100)], np.uint64).tobytes()) for i in range(0, 33, 11)]  # 89 of 111 in common: 0.8018
    table = spark.createDataFrame(near, "fp bigint, shingles binary")
    texts = spark.createDataFrame([(i, 100, i) for i, _ in near], "fp bigint, size int, root bigint")
    assert {tuple(r) for r in jaccard._by_rarest(texts, table).collect()} == {(0, 11), (11, 22)}


def test_a_family_is_joined_by_a_few_pairs_of_each_text(spark, monkeypatch):
    """Texts that differ in a few of the same places: a sixth of the pairs reach 0.8, and those join nearly all texts."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        words = [*base]
        for at in rng.sample(range(5, 145, 10), 2) + [rng.choice((2, 77, 148))]:
            words[at] = f"v{rng.randrange(3)}"
        texts.append(" ".join(words))
    assert len(set(texts)) > 290
    looked, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "BANDS", 0)  # nothing is joined by files of bands
    monkeypatch.setattr(jaccard, "bands", lambda values: [7])
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets: looked.append(pairs.count()) or verified(pairs, sets))
    got = jaccard.similar_texts(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"))
    assert {r["doc_id"]: r[f"{OWN}component"] for r in got.collect()} == dict(enumerate(brute(texts)))
    assert sum(looked) < 300 * 299 / 8


def test_pairs_beside_each_other_are_the_same_however_rows_are_batched():
    rows = {"token": [1] * 6 + [2] * 3, "fp": [*range(9)], "size": [100] * 9, "root": [0, 0, 2, 3, 4, 5, 6, 7, 7], "rank": [1] * 9}
    table = pa.table(rows)

    def pairs(size):
        return sorted((int(a), int(b)) for d in jaccard._beside(2)(iter(table.to_batches(size))) for a, b in zip(d["a"], d["b"]))

    assert pairs(100) == [(0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (3, 5), (4, 5), (6, 7), (6, 8)]
    assert pairs(1) == pairs(2) == pairs(4) == pairs(100)
