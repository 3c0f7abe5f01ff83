"""The corpus pipeline: documents to token files, a stage for each decision.

Every stage takes all that the one before it kept; all but the last return the columns
of ``documents``.  A caller writes each stage's result as Parquet and reads it again
(``run`` does so in the shared folder).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import materialize
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.mixing import training_order
from tidemark.llm.quality import filter_quality
from tidemark.llm.shingle_join import keep_one
from tidemark.llm.token_output import read_digest, write_tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not out of line."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return filter_quality(docs, trusted).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the smallest id."""
    return keep_one(docs, k=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each time a document is taken, cut where its source's target ends."""
    return training_order(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each document."""
    return read_digest(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Perplexities, tilings and token ids are beyond SQL.  Tests hold near duplicates and token counts against brute force, and the other stages against what they say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
