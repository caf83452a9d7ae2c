"""Token counts from a cache keyed by the digests of content and tokenizer version.

The cache is a folder of Parquet files, one sub-folder for each tokenizer version, with one row for each
distinct content. A batch of documents is joined to it by digest; only distinct contents that it lacks are
encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, text_or_empty, written

#: Texts handed to the tokenizer at once: bounds the ids held in memory.
TEXTS_AT_ONCE = 32


class Tokenizer:
    """A sentencepiece model as bytes, so that it reaches the executors with the task."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.model = f.read()

    def version(self) -> str:
        """Digest of everything that a count depends on besides the text."""
        import sentencepiece

        return hashlib.sha256(self.model + f"|sentencepiece {sentencepiece.__version__}|plain ids".encode()).hexdigest()

    def loaded(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)


def content_digest(text: Column) -> Column:
    """16 bytes of the SHA-256 of the normalised content. Null is normalised to empty; every other change of
    the text could change its count, so nothing else is folded together."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


class TokenCountCache:
    def __init__(self, spark: SparkSession, root: str, tokenizer: Tokenizer) -> None:
        self.spark, self.tokenizer = spark, tokenizer
        self.path = f"{root.rstrip('/')}/version={tokenizer.version()}"

    def stored(self) -> DataFrame:
        schema = "digest binary, n_tokens bigint"
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).dropDuplicates(["digest"])

    def counts(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_bytes, n_tokens for every row of docs (doc_id, text).

        Null text counts as empty, empty text has 0 tokens. Rows that repeat keep their own result rows; a null
        doc_id stays null. Other columns are not read.
        """
        docs = docs.select("doc_id", text_or_empty().alias("text"))
        ids = written(docs.select("doc_id", content_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes")), "token-ids")
        held = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("stands"))
        # one document stands for each content, so that copies of a hot text don't meet in one task
        misses = written(held.join(self.stored(), "digest", "left_anti").select("digest", "stands"), "token-misses")
        texts = docs.withColumn("digest", content_digest(F.col("text")))
        found = texts.join(misses.where("stands is not null").withColumnRenamed("stands", "doc_id").hint("shuffle_hash"), ["digest", "doc_id"]).select("digest", "text")
        # contents that only rows without a doc_id have are made one before they move
        unnamed = texts.where("doc_id is null").select("digest", "text").dropDuplicates(["digest"])
        found = found.unionByName(unnamed.join(misses.where("stands is null").select("digest"), "digest", "left_semi"))
        tokenizer = self.tokenizer

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = tokenizer.loaded()
            for b in batches:
                # rows that repeat a document come together
                firsts = {d: i for i, d in enumerate(b.column("digest").to_pylist())}
                b = b.take(pa.array(sorted(firsts.values()), pa.int64()))
                n, text = [], b.column("text")
                for i in range(0, len(text), TEXTS_AT_ONCE):
                    n += map(len, model.encode(text.slice(i, TEXTS_AT_ONCE).to_pylist(), num_threads=1))
                yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

        found.mapInArrow(encode, "digest binary, n_tokens bigint").write.mode("append").parquet(self.path)
        counted = held.select("digest", "n").join(self.stored(), "digest")
        return join_spread(ids, counted, ["digest"], ["doc_id", "n_bytes"], total=ids.count()).select("doc_id", "n_bytes", "n_tokens")


def token_counts(docs: DataFrame, cache_root: str, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens); see TokenCountCache.counts."""
    counts = TokenCountCache(docs.sparkSession, cache_root, Tokenizer(model_path)).counts(docs)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
