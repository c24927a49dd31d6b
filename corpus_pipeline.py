"""Cleaning documents for training: language, near-duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrid.llm import decontamination, jaccard_join, language_id, packing, pii
from leasegrid.llm.shared import held_out, small, stored, table

#: a document stays if one language holds at least this share of its letters
LANGUAGE_SHARE = 0.5
#: near-duplicates: five-word shingles, similarity of 0.8 or more
SHINGLE, SIMILAR = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those of which no learned language holds half of the letters;
    letters of scripts that no learned language uses are no language's."""
    model = language_id.learn(docs.where(~held_out()))
    return language_id.accepted(docs, model, LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near-duplicates."""
    classes = jaccard_join.jaccard_components(docs, n=SHINGLE, num=SIMILAR, den=100)
    copies = stored(classes.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(small(copies), "doc_id", "left_anti")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold an exact or edited copy of a benchmark item, or a part of one. Every row is
    judged by its own text, so null and repeated ids do not matter; null texts stay."""
    own = F.sha2(F.col("text").cast("binary"), 256)
    found = decontamination.find_items(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    leaks = stored(found.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return docs.join(small(leaks), own == F.col("leak"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; every document stays."""
    found = pii.with_spans(docs, pii.learn(docs))
    out = found.withColumn("text", pii.redacted(F.col("text"), F.concat("pii_base", "pii_added")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, without the ids themselves."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: no stage but the second can be said in SQL; tests/llm hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
