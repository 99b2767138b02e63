"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, with the columns of docs; the
last returns pieces of sequences. ``run`` writes what a stage keeps as Parquet in the shared folder and
hands the written rows to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.llm import decontaminate, jaccard, language, packing, quality
from embertrace.llm.common import written

ORACLE_SQL = None  # trained models decide; tests hold the stages against brute force


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    names = ("_language", "_language_score", "_language_accepted")
    found = language.predict(docs, language.fit(docs, F.lit(True)), names)
    return found.where("_language_accepted").drop(*names)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = written(quality.with_statistics(docs, ["doc_id"]), "statistics")
    model = quality.fit(quality.labelled_statistics(stats, labels, F.lit(True)))
    return quality.predict(docs, model, "_quality").where(F.col("_quality") >= quality.THRESHOLD).drop("_quality")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that the n-gram Jaccard join links."""
    return jaccard.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
