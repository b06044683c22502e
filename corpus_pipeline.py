"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Every stage but the last gives rows with the columns of its input. Rejected by score: toxic documents. One row of
each group stays: exact copies, then near copies (five-word shingles, similarity 0.8). Then sources are mixed to
their weights, which takes some documents twice or not at all, and what is taken is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillnet.llm.common import shared_path
from quillnet.llm.exact_dedup import kept_documents
from quillnet.llm.mixing import mixed_documents
from quillnet.llm.ngram_join import first_documents
from quillnet.llm.packing import packed
from quillnet.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_documents(docs, width=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Trained scores and a tokenizer's ids have no SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
