"""Corpus pipeline: the text operators applied one after the other to ``documents``.

Every stage takes what its predecessor kept and returns the columns of documents, the last
one adds the pieces of each text. Between stages the rows are written as Parquet and read
again.

Defined cases: a null text passes as an empty one would and is given back empty by the last
stage; very long texts go whole through every stage; of repeated rows one stays behind the
second stage; ties between near copies go to the smallest id, rows without an id stay unless
they are near a row with one; empty tables give no rows, and without labels no text passes the
first stage, where every score is 0.5; further columns of documents, whatever they are called,
are carried up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navscore.llm import decontaminate, piece_fst, quality_gam, simhash_gray, suffix_dedup
from navscore.llm.common import fresh, stored, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; learnt from these documents' labels."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs.columns, "quality_score")
    scored = quality_gam.score(docs, model, name)
    return scored.where(F.col(name) >= quality_gam.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints within two bits of each other."""
    return simhash_gray.keep_one(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of fifty words and more that occur more than once."""
    return suffix_dedup.dedup(docs, suffix_dedup.WORDS)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and the text that decoding them gives."""
    return piece_fst.encode_and_decode(docs, MODEL).select(
        "doc_id", "lang", "source", "n_chars", "piece_ids", F.col("decoded").alias("text")
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_text", repeated_text),
    ("benchmark_text", benchmark_text),
    ("pieces", pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
