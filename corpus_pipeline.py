"""From ``documents`` to token files: five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last
return rows with the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontamination, mixing, near_duplicates, quality, token_output
from factloom.llm.common import scratch, shared_dir, write_to

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return near_duplicates.unique_documents(docs, near_duplicates.Banding(similarity=(4, 5), k=5))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source repeats them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what they hold of it."""
    return token_output.read_documents(token_output.write_sequences(docs, TOKENIZER, END_ID))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_output", tokens),
]

#: No stage but mixing can be said in SQL; tests/llm/test_pipeline.py holds all
#: of them to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes for itself goes when its
    output is written; outputs and token files stay until the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with scratch(spark, keep="token-sequences"):
            docs = write_to(path, stage(spark, docs, sf_dir))
    return docs
