"""Cases that earlier versions of the operators lost, crashed on or multiplied."""

import gzip
import io

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from riskloom.llm import jaccard, pivots, queries, substrings, warc, winnow
from riskloom.llm.base import OWN


@pytest.mark.parametrize("name", ["op3_winnowing", "op4_warc", "op12_collocations"])
def test_queries_give_the_rows_of_their_sql(spark, small, name):
    fn, sql = queries.QUERIES[name]
    assert compare(spark, connect(small), fn, sql, small) == []


def test_vectors_of_every_length_are_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [5.0])]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"]: (r[f"{OWN}n_links"], r[f"{OWN}component_id"]) for r in got} == {
        1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7)}


def test_reference_points_grow_with_the_table():
    assert pivots.pivot_count(10_000) == pivots.PIVOTS < pivots.pivot_count(1 << 26) <= pivots.pivot_count(1 << 40) == pivots.PIVOTS_MOST


def test_repeated_words_on_both_sides(spark):
    same, distinct = "x " * 3000, " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, same), (2, distinct), (3, same + distinct)], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", same), ("b", distinct), ("c", same)], "item_id string, text string")
    got = {r["doc_id"]: (r[f"{OWN}n_hit"], r[f"{OWN}items"]) for r in winnow.contamination(docs, items).collect()}
    assert got == {1: (3000, ["a", "c"]), 2: (3000, ["b"]), 3: (6000, ["a", "b", "c"])}


def test_own_column_names_may_be_taken(spark):
    docs = spark.createDataFrame([(1, "abc" * 100, 5), (2, None, 6)], "doc_id bigint, text string, ranges int")
    assert sorted((r["doc_id"], r["ranges"], r[f"{OWN}removed"]) for r in substrings.remove_repeats(docs).collect()) == [(1, 5, 300), (2, 6, 0)]


def test_every_archive_is_read_by_a_task_of_its_own(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html")).repartition(50)
    folder = f"file://{tmp_path}/archives"
    archives = warc.write_archives(pages, folder)
    assert archives.count() == 50
    read = warc.read_archives(archives, folder)
    parts = read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert read.count() == 400 and parts > 25
    empty = warc.write_archives(pages.where("false"), folder)
    assert warc.read_archives(empty, folder).count() == 0


def test_an_archive_cut_inside_a_header(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "some page")], "page_id bigint, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/archives"
    name = warc.write_archives(pages, folder).first()["archive"]
    with open(tmp_path / "archives" / name, "rb") as f:
        whole = gzip.decompress(f.read())
    cut = whole[: whole.lower().index(b"content-length")]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(cut + b"\r\n\r\n"))))


def test_a_family_with_a_common_template_makes_few_pairs(spark):
    """Texts at similarity 0.6 of each other: the rarest fifth of each is its own."""
    template = [f"t{i}" for i in range(300)]
    texts = [" ".join([*template, *(f"u{k}_{i}" for i in range(96))]) for k in range(120)]
    docs = spark.createDataFrame([*enumerate(texts)], "fp bigint, text string")
    sets = jaccard.map_arrow(docs.select("text"), jaccard._sets, "fp bigint, shingles binary")
    sizes = sets.select("fp", (F.octet_length("shingles") / 8).cast("int").alias("size"), F.col("fp").alias("root"))
    assert jaccard._by_rarest(sizes, sets).count() == 0
    near = docs.union(spark.createDataFrame([(500, texts[0] + " and more")], "fp bigint, text string"))
    sets = jaccard.map_arrow(near.select("text"), jaccard._sets, "fp bigint, shingles binary")
    sizes = sets.select("fp", (F.octet_length("shingles") / 8).cast("int").alias("size"), F.col("fp").alias("root"))
    assert jaccard._by_rarest(sizes, sets).count() == 1
