"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet into the folder that spark.checkpoint.dir names and reads it as
the next stage's docs. Every stage returns no row for an empty table, and treats
rows with null ids as documents of their own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import shared_folder
from riskloom.llm.lines import drop_boilerplate
from riskloom.llm.mixing import mix_sources
from riskloom.llm.packing import pack
from riskloom.llm.quality import ANY_LENGTH, quality_filter
from riskloom.llm.simhash import drop_near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Short ones stay if nothing else is wrong with them; null and empty texts go. Repeated rows share their verdict."""
    return quality_filter(docs, rules=ANY_LENGTH)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on three or more sources leave every document but that of the smallest id; n_chars follows the text. Null texts stay null; a null source is one source."""
    return drop_boilerplate(docs, site_col="source", min_sites=3).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose five-word shingle sets are 0.8 similar. Texts without words, nulls among them, are copies of each other."""
    return drop_near_duplicates(docs, shingle_words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their documents; a document stands as often as its Poisson count. A null source is one source."""
    return mix_sources(docs, exponent=0.5, copy_col=None, shuffle_col=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024. A null or empty text is its end mark alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=0)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Shingle sets and token ids have no SQL form as a whole; tests hold the rows of every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus: all stages in turn over documents."""
    at, docs = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
