"""The operators as stages over ``documents``: each takes and returns whole rows of that table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.base import OWN, folds, map_arrow, table
from riskloom.llm.jaccard import similar_texts
from riskloom.llm.langid import predict_language
from riskloom.llm.raking import mix
from riskloom.llm.substrings import remove_repeats
from riskloom.llm.winnow import contamination
from riskloom.session import pin


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; null texts and texts without a letter go."""
    out = predict_language(docs, folds(F.col("doc_id"), 4) != 2)
    return out.where(F.col(f"{OWN}lang_pred") != "und").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: that of the smallest id, and of rows repeating it the first by content.

    Pairs come from SimHash fingerprints of shingles of five words and, where those reach too little, from bands; texts
    are near from an exact similarity of 0.8 of these shingles. A group without any id keeps
    its first row by content. Other columns are not looked at.
    """
    row = f"{OWN}row"
    numbered = docs.select("doc_id", "text", F.xxhash64(*docs.columns).alias(row))
    grouped = similar_texts(numbered)
    # A group's key is its smallest id; groups that have none are told apart by their root.
    key = [F.col(f"{OWN}component").alias("c"), F.when(F.col(f"{OWN}component").isNull(), F.col(f"{OWN}root")).alias("f")]
    first = pin(grouped.groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", row)).alias("m"), F.count("*").alias("rows")))
    keep = first.select(F.col("m.doc_id").alias(f"{OWN}id"), F.col(f"m.{row}").alias(row)).distinct()
    marked = docs.withColumn(row, F.xxhash64(*docs.columns))
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep[f"{OWN}id"]) & (marked[row] == keep[row]), "left_semi")
    # Rows equal in every column are one row more than once.
    twice = pin(kept.groupBy("doc_id", row).count().where("count > 1").drop("count"))
    same = kept["doc_id"].eqNullSafe(twice["doc_id"]) & (kept[row] == twice[row])
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates()).select(*docs.columns)


def _texts(batches):
    for batch in batches:
        kept = [k.decode("utf-8", "ignore") for k in batch.column(f"{OWN}kept").to_pylist()]
        yield {n: batch.column(n) for n in batch.schema.names if n != f"{OWN}kept"} | {f"{OWN}text": kept}


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings out of the texts; every document stays. A character cut in part goes whole.

    ``n_chars`` is counted anew. A null text becomes empty.
    """
    out = remove_repeats(docs)
    out = out.select(*[f"`{c}`" for c in docs.columns if c != "text"], f"{OWN}kept")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != f"{OWN}kept")
    text = F.col(f"{OWN}text")
    cut = map_arrow(out, _texts, f"{schema}, {OWN}text string")
    put = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return cut.select(*[put[c].alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns])


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no twentieth of their words with windows of the benchmark.

    Verdicts are made on narrow rows and reach the documents by the hash of their text, so the texts
    pass through no shuffle where the contaminated are few.
    """
    out = contamination(docs.select("text", F.xxhash64("text").alias("row"), F.length("text").alias("size")), table(spark, sf_dir, "benchmark"))
    bad = pin(out.where(F.col(f"{OWN}contaminated")).select("row", "size").distinct())
    keyed = docs.withColumns({f"{OWN}row": F.xxhash64("text"), f"{OWN}size": F.length("text")})
    return keyed.join(bad, (keyed[f"{OWN}row"] == bad["row"]) & (keyed[f"{OWN}size"] == bad["size"]), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by calibrated rates; adds ``topic``, ``tokens`` and ``mix_weight``."""
    out = mix(docs).where(F.col(f"{OWN}selected"))
    return out.select(*docs.columns, *[F.col(f"{OWN}{a}").alias(b) for a, b in (("topic", "topic"), ("tokens", "tokens"), ("weight", "mix_weight"))])
