import json
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators.evidence import evidence_text, prompt_text, query_text, top_contributions
from riskloom.operators.retrieval import HashedEncoder, Retriever, chunk, read_corpus, sentences, word_count


def chunks_of(text, budget=200):
    """The chunk rule stated over Python lists."""
    out, held = [], []
    for s in re.split(r"(?<=[.!?])\s+", text):
        if held and sum(len(h.split()) for h in held) + len(s.split()) > budget:
            out.append(" ".join(held))
            held = held[-2:]
        held.append(s)
    return [*out, " ".join(held)] if held else out


@pytest.mark.parametrize("budget", [5, 12, 200])
def test_chunks(spark, budget):
    rng = random.Random(budget)
    texts = ["", "one", " lead. Trail! ", "a b c d e f g h i j. k. l m.", "no stop here at all", "A. B?\nC!\x1cD"]
    texts += [rng.choice([" ", "\n\n"]).join(" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(1, 30))) + rng.choice(".!?;") for _ in range(40)) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunk(df, budget).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: chunks_of(t, budget) for i, t in enumerate(texts)}
    counts = df.select(word_count(F.col("text")), F.size(sentences(F.col("text")))).collect()
    assert [tuple(r) for r in counts] == [(len(t.split()), len(re.split(r"(?<=[.!?])\s+", t))) for t in texts]


def test_corpus_and_retrieval(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Large amounts late at night are unusual. They need a second look.")
    (tmp_path / "b.md").write_text("New devices with high value purchases.\nVerify them.")
    (tmp_path / "c.csv").write_text("not,policy")
    corpus = read_corpus(spark, str(tmp_path))
    assert corpus.count() == 2
    r = Retriever(HashedEncoder(64), top_k=3).build(corpus)
    asked = spark.createDataFrame([("q", "device purchase of high value")], "query_id string, query string")
    found = r.retrieve(asked).orderBy("rank").collect()
    assert len(found) == 2 and "devices" in found[0]["text"]
    again = Retriever.load(spark, r.save(str(tmp_path / "index"))).retrieve(asked).orderBy("rank").collect()
    assert [x["chunk_id"] for x in again] == [x["chunk_id"] for x in found]
    with pytest.raises(RuntimeError):
        Retriever().retrieve(asked)


def test_evidence(spark):
    df = spark.createDataFrame([({"new_device": 0.5, "amount_log": -1.25, "b": 0.5},), ({},)], "c map<string,double>")
    top = [[(e["feature"], e["value"]) for e in r[0]] for r in df.select(top_contributions(F.col("c"), 2)).collect()]
    assert top == [[("amount_log", -1.25), ("b", 0.5)], []]
    lines = [r[0] for r in df.select(evidence_text(F.col("c"), 2)).collect()]
    assert lines == ["  - amount_log: -1.2500 (decreases fraud risk)\n  - b: +0.5000 (increases fraud risk)", ""]
    q = df.select(query_text(F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(0.875), F.col("c"))).first()[0]
    assert q == "Transaction amount unknown in unknown category flagged with fraud score 0.88. Key signals: amount log, b, new device."


def test_prompt_holds_the_transaction(spark):
    df = spark.createDataFrame([("t1", 5.0)], "transaction_id string, amount double")
    text = df.select(prompt_text(F.to_json(F.struct("*")), F.lit(0.5), F.lit(0.25), F.lit("x"), F.array(F.lit("rule")))).first()[0]
    body = text.split("Transaction details:\n")[1].split("\n\nModel scores")[0]
    assert json.loads(body) == {"transaction_id": "t1", "amount": 5.0}
    assert "[Policy excerpt]\nrule" in text and "Anomaly score:     0.2500" in text
