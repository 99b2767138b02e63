"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, token count, byte count). A batch of
documents joins its digests to the cache; only digests that the cache lacks are encoded, once each,
and their counts are appended. The tokenizer digest covers the tokenizer's file, so counts of another
version are never reused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.llm.common import new_folder, slices, texts_of, written
from embertrace.llm.tokens import encoder, vocabulary

LIMIT = 512
CACHE_SCHEMA = "content string, tokenizer string, n_bytes bigint, n_tokens bigint"


def version_digest(name: str) -> str:
    with open(vocabulary(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class DigestCache:
    """Stored counts under one folder of a file system that all executors reach. Appending is one
    Spark write, so a lost executor leaves no half row; a digest appended twice by two writers
    carries equal counts and counts as one."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_folder(spark, "token-cache")

    def rows(self, version: str) -> DataFrame:
        found = self.spark.createDataFrame([], CACHE_SCHEMA)
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path):
            found = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        return found.where(F.col("tokenizer") == version).dropDuplicates(["content"])

    def append(self, counts: DataFrame) -> None:
        counts.write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: DigestCache) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text); whole texts.

    A null text counts as empty; repeated rows, null ids and equal texts each keep their row; an
    empty table gives no rows and appends nothing. Other columns of ``docs`` are ignored.
    """
    version = version_digest(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    # The byte count is part of the key: the row's own text is then never needed again.
    keyed = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("content"))
    keyed = written(keyed, "digests")
    known = cache.rows(version).select("content")
    # One id stands for each digest that the cache lacks. Copies of a text meet here as one row a task.
    misses = keyed.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(known, "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for part in slices(batches):
            texts = texts_of(part)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([version] * len(texts)),
                 pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(ids) // 4 for ids in coder.encode(texts)], pa.int64())],
                ["content", "tokenizer", "n_bytes", "n_tokens"])

    whole = docs.select("doc_id", text.alias("text"))
    # Ids may repeat with other texts, or be null: the digest is compared as well.
    wanted = (
        whole.join(misses.select(F.col("doc_id").alias("of"), "content"), F.col("doc_id").eqNullSafe(F.col("of")))
        .where(F.sha2(F.col("text").cast("binary"), 256) == F.col("content"))
        .select("content", "text")
    )
    cache.append(wanted.mapInArrow(encode, CACHE_SCHEMA).dropDuplicates(["content"]))
    # Read back first: a plain join of two tables can be split where one content has very many copies.
    counts = written(cache.rows(version), "counts")
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")


def with_limit(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
