"""Benchmark contamination of documents by winnowed word grams; DataFrame functions only.

A span of ``WINDOW`` words holds ``PICK`` grams of ``GRAM`` words; the smallest of their hashes is a
fingerprint. Equal spans have equal smallest hashes, so every shared span yields a common
fingerprint. Fingerprints of documents and items are joined, and each common one is extended
word by word to the spans around it, so that nothing rests on hashes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import KEY, OWN, text_key
from riskloom.session import pin

WINDOW = 13
GRAM = 7
PICK = WINDOW - GRAM + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters in lower case and all characters beyond ASCII; none for a null."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS)
    return F.filter(parts, lambda w: w != "")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column, computed once a row: the optimizer would copy its expression into every lambda step."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _grams(found: Column, n: Column, size: int) -> Column:
    """Hash of the ``size`` words from each position."""
    none = F.array().cast("array<bigint>")
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(found, i, size)))).otherwise(none)


def _least(grams: Column) -> Column:
    """The smallest of every ``PICK`` neighbouring hashes, each once."""
    none = F.array().cast("array<bigint>")
    count = F.size(grams) - PICK + 1
    return F.array_distinct(
        F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_min(F.slice(grams, i, PICK)))).otherwise(none)
    )


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with the contamination of each row under the prefix ``base.OWN``.

    Added: ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items`` (items with
    occurring windows), ``items`` (their ids as sorted texts) and ``contaminated`` (a twentieth of the
    words are hit, and one at least). A window is ``WINDOW`` neighbouring words of an item, or the
    whole of a shorter one. Null and wordless texts and items match nothing; an item with a null id
    hits words but is not counted or named; repeated items count once. Every row stays.
    """
    item = settled(benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("t")), "iw", words(F.col("t"))).drop("t")
    item = pin(item.where(F.size("iw") > 0).withColumn("il", F.size("iw")).distinct())
    short = [r["il"] for r in item.where(F.col("il") < WINDOW).select("il").distinct().orderBy("il").collect()]

    grams = _grams(F.col("iw"), F.col("il"), GRAM)
    picked = settled(settled(item.where(F.col("il") >= WINDOW), "g", grams), "p", _least(F.col("g")))
    brief = item.where(F.col("il") < WINDOW)
    marks = picked.select(F.explode("p").alias("gram")).union(brief.select(F.xxhash64("iw").alias("gram"))).distinct()
    # Every window of the items, each once for an item that repeats it.
    each = F.transform(F.sequence(F.lit(1), F.col("il") - WINDOW + 1), lambda i: F.slice("iw", i, WINDOW))
    windows = item.where(F.col("il") >= WINDOW).select("item", F.explode(F.array_distinct(each)).alias("words"))
    windows = windows.union(brief.select("item", F.col("iw").alias("words"))).distinct()
    windows = pin(windows.withColumns({"span": F.size("words"), "window": F.xxhash64("words")}))

    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    given = settled(docs.withColumns(text_key(body)), f"{OWN}words", words(body)).withColumn(f"{OWN}n_words", F.size(f"{OWN}words"))
    found, n = F.col(f"{OWN}words"), F.col(f"{OWN}n_words")
    given = settled(given, f"{OWN}grams", _grams(found, n, GRAM))
    prints = F.concat(_least(F.col(f"{OWN}grams")), *[F.array_distinct(_grams(found, n, size)) for size in short])
    kept = [c for c in docs.columns if c != text]
    rows = pin(given.select(*[F.col(f"`{c}`") for c in kept], *KEY, f"{OWN}n_words", prints.alias(f"{OWN}prints")))

    shared = rows.select(*KEY, F.explode(f"{OWN}prints").alias("gram")).join(marks, "gram")
    shared = pin(shared.groupBy(*KEY).agg(F.collect_set("gram").alias("grams")))
    # One row for each text: copies have the same words.
    hit = docs.select(body.alias("body")).withColumns(text_key(F.col("body"))).join(shared, KEY)
    hit = hit.groupBy(*KEY).agg(F.first("body").alias("body"), F.first("grams").alias("grams"))
    hit = settled(hit, "w", words(F.col("body"))).drop("body").withColumn("n", F.size("w"))
    # Windows of the text around each shared gram, as (start, hash, words): made before rows multiply, so that they stay short.
    at = F.filter(
        F.transform(_grams(F.col("w"), F.col("n"), GRAM), lambda h, i: F.when(F.array_contains(F.col("grams"), h), i)), lambda i: i.isNotNull()
    )
    first = lambda i: F.greatest(i - PICK + 1, F.lit(0))
    starts = F.flatten(F.transform(F.filter(at, lambda i: first(i) <= F.least(i, F.col("n") - WINDOW)), lambda i: F.sequence(first(i), F.least(i, F.col("n") - WINDOW))))
    hit = settled(hit, "starts", F.array_distinct(starts))
    spans = [F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("w", s + 1, WINDOW).alias("words")))]

    def whole(size: int) -> Column:
        piece = lambda i: F.struct(i.alias("start"), F.slice("w", i + 1, size).alias("words"))
        found = F.transform(_grams(F.col("w"), F.col("n"), size), lambda h, i: F.when(F.array_contains(F.col("grams"), h), piece(i)))
        return F.filter(found, lambda x: x.isNotNull())

    spans += [whole(size) for size in short]
    found_at = hit.select(*KEY, F.explode(F.concat(*spans)).alias("x")).select(*KEY, "x.start", "x.words", F.size("x.words").alias("span"), F.xxhash64("x.words").alias("window"))
    # Joined by hash and compared word by word. A place is kept once however many items have its window, and an item
    # once however many places: positions of a text and of an item never multiply.
    known = windows.select("span", "window", "words").distinct()
    covered = pin(found_at.join(known, ["span", "window", "words"], "left_semi"))
    named = covered.select(*KEY, "span", "window", "words").distinct().join(windows, ["span", "window", "words"])
    named = named.select(*KEY, "item").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias(f"{OWN}items"))
    words_hit = F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["span"] - 1)))
    result = covered.groupBy(*KEY).agg(F.collect_set(F.struct("start", "span")).alias("spans"))
    result = result.select(*KEY, F.size(F.array_distinct(words_hit)).alias(f"{OWN}n_hit")).join(named, KEY, "left")
    out = rows.drop(f"{OWN}prints").join(result, KEY, "left").drop(*KEY)
    none = F.array().cast("array<string>")
    out = out.withColumns({
        f"{OWN}n_words": n.cast("long"), f"{OWN}n_hit": F.coalesce(f"{OWN}n_hit", F.lit(0)).cast("long"),
        f"{OWN}items": F.coalesce(f"{OWN}items", none), f"{OWN}n_items": F.size(F.coalesce(f"{OWN}items", none)).cast("long"),
    })
    return out.withColumn(f"{OWN}contaminated", (F.col(f"{OWN}n_hit") > 0) & (20 * F.col(f"{OWN}n_hit") >= F.col(f"{OWN}n_words")))
