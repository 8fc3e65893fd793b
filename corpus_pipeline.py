"""Corpus cleaning: language, near duplicates, benchmark leaks, personal data, pieces.

Each stage takes all that the one before kept and returns the columns of documents,
except the last, which returns the encoded texts. Stages read their input from
Parquet, so a lost executor costs a stage's tasks and not the chain.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, jaccard_join, language_id, pieces, pii
from tallyloom.llm.shared import stored

#: Texts whose best language is less likely than this, hardly above chance, are rejected, and those without a letter.
LEAST_SCORE = 0.35


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that have no letter or resemble none of the labelled languages."""
    known = language_id.identify(docs, language_id.fit(docs))
    kept = known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near duplicates, and of repeated rows one."""
    return jaccard_join.without_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a passage of the benchmark."""
    found = decontaminate.annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).drop("leaks")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in the place of each piece of personal data; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids of each text that is left."""
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", languages),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("pii", without_personal_data),
    ("pieces", encoded),
]

#: Models and iterated graphs have no SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
