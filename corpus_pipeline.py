"""A corpus from raw documents to packed training sequences, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result
as Parquet to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrix.llm import line_dedup, ngram_join, packing, quality, scratch, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: None: tokenization and a trained model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents that have (``left_semi``) or lack (``left_anti``) their id in ``ids``."""
    named = ids.select(F.col("doc_id").alias("__id"))
    return docs.join(named.hint("merge"), F.col("doc_id") == F.col("__id"), how).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go, and lines over the limit from the others; ``n_chars`` follows the text."""
    done = quality.quality(docs, carry=["lang", "source"]).where("kept")
    return done.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.char_length("cleaned").cast("long").alias("n_chars"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; the model learns from the labels of the documents at hand."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.train(docs, labels), carry=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in 5 documents stay in one; ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs.withColumn("__rest", F.struct("doc_id", "lang", "source")), 40, 5, carry=["__rest"])
    return done.select("__rest.doc_id", F.col("kept").alias("text"), "__rest.lang", "__rest.source", F.char_length("kept").cast("long").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in four fifths of their five-word shingles, the one with the smallest id stays."""
    return _only(docs, ngram_join.similar_components(docs, 5, 80, 100).where("component_id < doc_id"), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("line dedup", without_common_lines),
    ("n-gram jaccard join", one_of_each_group),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
