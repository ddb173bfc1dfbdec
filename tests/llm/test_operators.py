"""Each operator against brute force on small tables, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import io
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import brown, langid, pivots, raking, simhash, sorting, substrings, warc, winnow, wrappers
from riskloom.llm.base import BATCH_BYTES, KEY, OWN, folds

LONG = " ".join(f"w{i % 997}x{i}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    (1, "a few plain words here"), (2, "a few plain words here"), (3, None), (4, ""), (5, "x"), (6, LONG), (7, f"head one {PASSAGE} tail one"),
    (8, f"another start {PASSAGE} another end"), (9, "ab" * 400), (None, "row without an id and some words"), (2, "a few plain words here"),
    (10, LONG + " one more"), (11, "é" * 300), (12, "123 456"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "own", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept string, node bigint").cache()


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 9, 60):
        for symbols in (1, 2, 200):
            text = rng.integers(1, symbols + 1, n).astype(np.uint16)
            text[-1:] = 0
            assert sorting.suffix_array(text, n + 1).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_hashing_holds_little_at_once():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 2_000).astype(np.uint8).tobytes().decode() for _ in range(4_000)]
    numbers = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, pa.array(texts)], names=[*KEY, f"{OWN}text"])
    tracemalloc.start()
    try:
        found = [len(x["gram"]) for x in substrings._choose(200)([batch])]
        assert sum(found) > len(texts) and tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


def test_pipeline_stages_read_small_batches(spark, small, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    corpus_pipeline.run(spark, small)
    assert seen == [str(BATCH_BYTES)] * 2 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield gone


@pytest.mark.parametrize("crowded", [substrings.CROWDED, {1: 8, 2: 1}, {1: 32}])
def test_repeated_strings(docs, monkeypatch, crowded):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    got = substrings.remove_repeats(docs).select("doc_id", "kept", f"{OWN}size", f"{OWN}removed", f"{OWN}spans", f"{OWN}sha", f"{OWN}kept").collect()
    texts = [(t or "").encode() for _, t in TEXTS]
    want = []
    for (i, _), t, gone in zip(TEXTS, texts, brute_removed(texts, 200)):
        rest = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, "own", len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((*r[:6], bytes(r[6])) for r in got), key=key) == sorted(want, key=key)


def test_fingerprints_and_groups(docs):
    got = {(r["doc_id"], r["fp"]): r["c"] for r in simhash.near_duplicates(docs).select("doc_id", F.col(f"{OWN}fp").alias("fp"), F.col(f"{OWN}component").alias("c")).collect()}

    def slow(text):
        words = (text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        x = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        return x - (1 << 64) if x >> 63 else x

    assert set(got) == {(i, slow(t)) for i, t in TEXTS}
    by = {i: c for (i, _), c in got.items()}
    assert by[1] == by[2] == 1 and by[3] == by[4] == 3 and by[6] == by[10] == 6 and by[None] is None


def test_links_by_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 8)
    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)}
    centre = int(rng.integers(-(1 << 62), 1 << 62))
    for _ in range(150):
        x = centre
        for b in rng.choice(63, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values = sorted(values)
    label = {v: v for v in values}
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    for _ in values:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    from riskloom.llm.components import components

    roots = components(simhash.near_edges(spark.createDataFrame([(v,) for v in values], "fp bigint")))
    assert {r["node"]: r["root"] for r in roots.collect()} == {v: r for v, r in label.items() if v != r}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivots, "LIST_BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    base = np.array(rows[0][1])
    rows += [(100 + i, (base * 3 + rng.normal(size=16) * 0.02).tolist()) for i in range(40)]
    rows += [(200, rows[0][1]), (201, None), (202, [0.0] * 16), (203, [math.nan] * 16), (204, [None] * 16), (205, []), (None, rows[5][1]), (206, [1.0])]
    got = pivots.near_vectors(spark.createDataFrame([(*r, 9) for r in rows], "vec_id bigint, embedding array<double>, links int"))
    assert got.count() == len(rows)
    links = {r["vec_id"]: (r[f"{OWN}n_links"], r[f"{OWN}component_id"]) for r in got.collect()}
    sound = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    for i, v in sound:
        assert links[i][0] == sum(float(v @ w) >= 0.95 for _, w in sound) - 1
    assert links[100] == links[139] == links[200] == (41, 0) and links[None][1] == 5
    assert all(links[i] == (0, i) for i in (201, 202, 203, 204, 205, 206))


def test_contamination(spark, docs):
    items = [("long", PASSAGE), ("brief", "plain words"), (None, "some words"), ("none", ""), ("null", None), ("brief", "plain words"), ("b", " ".join(f"shared{i}" for i in range(10, 30)))]
    got = winnow.contamination(docs, spark.createDataFrame(items, "item_id string, text string"))
    for r in got.collect():
        if r["doc_id"] in (1, 2):
            assert (r[f"{OWN}n_words"], r[f"{OWN}n_hit"], r[f"{OWN}items"], r[f"{OWN}contaminated"]) == (5, 2, ["brief"], True)
        elif r["doc_id"] in (7, 8):
            assert (r[f"{OWN}n_words"], r[f"{OWN}n_hit"], r[f"{OWN}items"]) == (64, 60, ["b", "long"])
        elif r["doc_id"] is None:
            assert (r[f"{OWN}n_hit"], r[f"{OWN}n_items"]) == (2, 0)
        else:
            assert not r[f"{OWN}contaminated"] and r[f"{OWN}n_hit"] == 0
    assert got.count() == len(TEXTS)


def test_class_scores(docs, monkeypatch):
    monkeypatch.setattr(brown, "KNOWN", 20)  # most words come by the join
    monkeypatch.setattr(brown, "PLACED", 2)
    monkeypatch.setattr(brown, "CORE", 5)
    held = folds(F.col("doc_id"), 7) == 2
    got = brown.class_scores(docs, ~held).collect()
    split = [(brown.tokens((t or "").encode()), zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2) for i, t in TEXTS]
    seen = Counter(w for words, out in split if not out for w in words)
    n, v = sum(seen.values()), len(seen)
    want = sorted((len(w), sum(x in seen for x in w), round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 6)) for w, _ in split)
    assert sorted((r[f"{OWN}n_tokens"], r[f"{OWN}n_known"], round(r[f"{OWN}base_score"], 6)) for r in got) == want
    assert all(r[f"{OWN}train_tokens"] == n and r[f"{OWN}score"] <= 0 for r in got)


def test_exchange_never_loses_likelihood():
    rng = np.random.default_rng(0)
    size, fixed = 24, 4
    table = rng.integers(0, 5, (size, size))
    table[:10, 10:20] += 30
    table[10:20, :10] += 30
    pairs = np.flatnonzero(table.ravel())

    def value(label):
        k = label.max() + 1
        c = np.zeros((k, k))
        np.add.at(c, (label[pairs // size], label[pairs % size]), table.ravel()[pairs])
        g = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
        return g(c) - g(c.sum(0)) - g(c.sum(1))

    start = np.concatenate([np.arange(size - fixed) % 2, 2 + np.arange(fixed)])
    label = brown.exchange(pairs, table.ravel()[pairs], size - fixed, size, classes=2)
    assert value(label) >= value(start)
    assert len(set(label[:10])) == len(set(label[10:20])) == 1 and label[0] != label[10]


def test_network_gradients():
    net = langid.ByteTagger(["a", "b", "c"])
    for store in (net.ahead, net.behind):
        store.params = {k: v.astype(np.float64) for k, v in store.params.items()}
    net.top = {k: v.astype(np.float64) for k, v in net.top.items()}
    rng = np.random.default_rng(0)
    x, keep, y = rng.integers(0, 256, (6, 4)), np.ones((6, 4)), np.array([0, 1, 2, 0])
    keep[4:, 1] = 0
    _, grads = net.gradients(x, keep, y)
    for store, grad in zip((net.ahead.params, net.behind.params, net.top), grads):
        for k, g in grad.items():
            at = np.unravel_index(np.abs(g).argmax(), g.shape)
            old = store[k][at]
            store[k][at] = old + 1e-4
            up = net.gradients(x, keep, y)[0]
            store[k][at] = old - 1e-4
            down = net.gradients(x, keep, y)[0]
            store[k][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-4, rel=1e-3)


def test_languages(spark):
    rows = [(i, f"{w} " * 60, lang) for i in range(80) for w, lang in (("the cat and house", "en"), ("über straße und", "de"))]
    rows += [(500, None, "en"), (501, "123 -- 4", "de"), (502, "the house", None), (503, "straße", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict_language(df, F.col("doc_id") < 60).where("doc_id >= 60").collect()}
    assert got[500][f"{OWN}lang_pred"] == got[501][f"{OWN}lang_pred"] == "und" and got[502][f"{OWN}lang_pred"] == "en"
    assert got[503][f"{OWN}lang_pred"] == "de" and 0.5 < got[70][f"{OWN}score"] <= 1
    assert {r[f"{OWN}lang_pred"] for r in langid.predict_language(df, F.lit(False)).collect()} == {"und"}


def test_archives(spark, tmp_path):
    big = "<p>x</p>" * 200
    rows = [(1, "http://a/é\r\nX: 1", big), (2, None, big), (3, "u", None), (None, "u", big), (4, "u", "small"), (5, "u", "small"), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    back = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    assert len(back) == len(rows)
    for r in back:
        html = big if r["page_id"] in (1, 2, None) else "" if r["page_id"] == 3 else "small"
        again = r["page_id"] in (1, None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if again else ("response", None))
        assert again or bytes(r["payload"]) == html.encode()
    record = warc.encode_record("response", "<urn:x-page:1>", "u", b"body", hashlib.sha1(b"body").hexdigest())
    assert [p for _, p in warc.read_records(io.BytesIO(record * 3))] == [b"body"] * 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(record[:-9])))
    wrong = warc.encode_record("response", "<urn:x-page:1>", "u", b"body", "0" * 40)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(wrong)))


def test_raking_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 11 else None, "en" if i % 4 else "de") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("tokens", F.lit(1))
    aim = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double")
    got = raking.mix(df, targets={"language": aim}).toPandas()
    assert len(got) == 400
    total = got[f"{OWN}tokens"].sum()
    share = (got[f"{OWN}tokens"] * got[f"{OWN}rate"] * got[f"{OWN}weight"]).groupby(got["lang"]).sum() / total
    assert share["en"] == pytest.approx(0.5, abs=1e-5) and share["de"] == pytest.approx(0.5, abs=1e-5)
    assert (got[f"{OWN}tokens"] * got[f"{OWN}rate"]).sum() == pytest.approx(total / 2, rel=1e-6)


PAGE = (
    '<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use '
    'cookies</div><div id="content"><h2>{t}</h2><p>Story {k} &amp; mo<b>re</b><br>x<p>Follow us everywhere</p></div><div class=sidebar>s{k}</div>'
    '<form>q</form><section id="comments"><p>reader {k}</p></section><footer>c</footer><script>var a="<p>";</script></body></html>'
)


def test_main_text(spark):
    rows = [(i, "http://h.example/a", PAGE.format(t=f"T{i}", k=i)) for i in range(6)]
    rows += [(10, None, None), (11, "bad", ""), (12, "http://o.example", "<article><p>One &lt;two&gt;\n three<div>four</article>after"), (0, rows[0][1], rows[0][2])]
    got = {r["page_id"]: r[f"{OWN}text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1] == "T1\nStory 1 & more x" and got[10] == got[11] == "" and got[12] == "One <two> three\nfour"


def test_copies_of_an_article_keep_their_text():
    page = PAGE.format(t="T", k=1)
    wrapper = wrappers._wrap(wrappers.parse(page)[0])
    for _ in range(5):
        wrapper = wrappers.merge(wrapper, wrappers._wrap(wrappers.parse(page)[0]))
    assert wrappers.content(page, wrappers.template_texts(wrapper)) == "T\nStory 1 & more x\nFollow us everywhere"


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id string, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for out in (
        substrings.remove_repeats(none), simhash.near_duplicates(none), winnow.contamination(none, items), brown.class_scores(none, F.lit(True)),
        langid.predict_language(none, F.lit(True)), raking.mix(none), wrappers.main_text(pages),
        pivots.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")),
    ):
        assert out.count() == 0
    assert winnow.contamination(docs, items).where(f"{OWN}n_hit > 0").count() == 0


def test_recall_of_vectors(spark):
    """Links found among clusters of all sizes against brute force: nine of ten at least, and none below the threshold."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(120, 32))
    rows = np.concatenate([c + rng.normal(size=(1 + k % 9, 32)) * 0.15 for k, c in enumerate(centres)])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    got = pivots.near_vectors(spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>"))
    found = np.array([r[f"{OWN}n_links"] for r in got.orderBy("vec_id").collect()])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum() > 0
