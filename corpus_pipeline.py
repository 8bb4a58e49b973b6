"""A training corpus from raw documents: quality, repeated lines, near copies, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.llm import near_dedup, packing, passages, quality
from stylograph.llm.common import landed, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    judged = quality.keep_good(docs, table(spark, sf_dir, "labels"))
    return judged.select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated passages go; a document of which nothing but white space is left goes too."""
    edited = passages.dedup_passages(docs).where((F.col("words_removed") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike(r"\S"))
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.when(F.col("words_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return edited.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("best-fit packing", packed_sequences),
]

#: No stage can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
