"""Text corpus jobs: sentences, word-budget chunks, embeddings and top-k excerpts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.neighbors import inner_product_top_k
from riskloom.session import fill_cores, pin

# --- fixed values: what counts as white space, and the chunking defaults ---
SPACES = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
CHUNK_WORDS = 200
CARRIED_SENTENCES = 2


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of all .txt and .md files, each file one row."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}")
    return files.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows a full stop, exclamation or question mark."""
    return F.split(text, f"(?<=[.!?])[{SPACES}]+")


def word_count(text: Column) -> Column:
    """Words between white space. Pieces of a split, less the empty ones at either end."""
    pieces = F.size(F.split(text, f"[{SPACES}]+"))
    edges = F.rlike(text, F.lit(f"^[{SPACES}]")).cast("int") + F.rlike(text, F.lit(f"[{SPACES}]\\z")).cast("int")
    return F.when(text == "", 0).otherwise(pieces - edges)


def chunk(df: DataFrame, words: int = CHUNK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, text): whole sentences up to the budget, the last two carried into the next chunk.

    One fold per document. It keeps only where a chunk starts and its word count; texts are
    cut out of the sentence array afterwards, so the fold's state stays small.
    """
    parted = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col), sentences(F.col(text_col)).alias("_s"))
    counted = parted.withColumn("_n", F.transform("_s", word_count))

    def step(acc: Column, i: Column) -> Column:
        n = F.get(F.col("_n"), i)
        full = (acc["held"] + n > words) & (i > acc["start"])
        start = F.when(full, F.greatest(acc["start"], i - CARRIED_SENTENCES)).otherwise(acc["start"])
        carried = F.coalesce(F.get(F.col("_n"), i - 1), F.lit(0)) + F.when(
            i - CARRIED_SENTENCES >= acc["start"], F.coalesce(F.get(F.col("_n"), i - CARRIED_SENTENCES), F.lit(0))
        ).otherwise(0)
        closed = F.array(F.struct(acc["start"].alias("a"), (i - 1).alias("b")))
        return F.struct(
            start.alias("start"),
            (F.when(full, carried).otherwise(acc["held"]) + n).alias("held"),
            F.when(full, F.concat(acc["done"], closed)).otherwise(acc["done"]).alias("done"),
        )

    empty = F.array().cast("array<struct<a:int,b:int>>")
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("held"), empty.alias("done"))
    size = F.size("_s")
    spans = F.aggregate(
        F.sequence(F.lit(0), size - 1),
        zero,
        step,
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("a"), (size - 1).alias("b")))),
    )
    cut = counted.select(id_col, "_s", F.posexplode(spans).alias("chunk", "_span"))
    text = F.array_join(F.slice("_s", F.col("_span.a") + 1, F.col("_span.b") - F.col("_span.a") + 1), " ")
    return cut.select(id_col, "chunk", text.alias("text"))


Encoder = Callable[[DataFrame, str], DataFrame]


class HashedEncoder:
    """Hashed term weights, L2-normalised: the default encoder. Any callable of the same shape may replace it."""

    def __init__(self, dims: int = 512):
        self.dims = dims
        self.model: PipelineModel | None = None

    def fit(self, corpus: DataFrame, text_col: str = "text") -> "HashedEncoder":
        stages = [
            RegexTokenizer(inputCol=text_col, outputCol="_words", pattern="[^\\p{L}\\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=self.dims),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
        ]
        self.model = Pipeline(stages=stages).fit(corpus)
        return self

    def __call__(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Add ``features`` (array of floats)."""
        out = self.model.transform(df if text_col == "text" else df.withColumn("text", F.col(text_col)))
        return out.withColumn("features", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")


class Retriever:
    """Chunked, embedded corpus answering top-k text queries."""

    def __init__(self, encoder: HashedEncoder | None = None, top_k: int = 3, chunk_size: int = CHUNK_WORDS):
        self.encoder, self.top_k, self.chunk_size = encoder or HashedEncoder(), top_k, chunk_size
        self.index: DataFrame | None = None

    def build(self, corpus: DataFrame) -> "Retriever":
        chunks = pin(chunk(fill_cores(corpus), self.chunk_size))
        if hasattr(self.encoder, "fit"):
            self.encoder.fit(chunks)
        keyed = chunks.withColumn("chunk_id", F.concat_ws("/", F.col("doc_id").cast("string"), F.lpad(F.col("chunk").cast("string"), 6, "0")))
        self.index = pin(self.encoder(keyed, "text").select("chunk_id", "text", "features"))
        return self

    def retrieve(self, queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
        """(query_id, rank, chunk_id, score, text): min(k, chunks) excerpts per query."""
        if self.index is None:
            raise RuntimeError("Build the Retriever before retrieving.")
        asked = self.encoder(queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
        refs = self.index.select(F.col("chunk_id").alias("id"), "features")
        found = inner_product_top_k(asked.select("id", "features"), refs, self.top_k)
        texts = self.index.select(F.col("chunk_id").alias("match_id"), "text")
        return found.join(texts, "match_id").select("query_id", "rank", F.col("match_id").alias("chunk_id"), "score", "text")

    def save(self, path: str) -> str:
        self.index.write.mode("overwrite").parquet(f"{path}/index")
        self.encoder.model.write().overwrite().save(f"{path}/encoder")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, top_k: int = 3) -> "Retriever":
        out = cls(top_k=top_k)
        out.index = spark.read.parquet(f"{path}/index")
        out.encoder.model = PipelineModel.load(f"{path}/encoder")
        return out
