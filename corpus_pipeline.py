"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.llm.common import read, stored
from aislewise.llm.decontam import without_matches
from aislewise.llm.jaccardjoin import jaccard_components, one_of_each
from aislewise.llm.langid import keep_languages, learn_languages
from aislewise.llm.linededup import dedup_lines
from aislewise.llm.packing import pack_documents

LEAST_SCORE = 0.35  # mean probability below which a text has no language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; texts that are null, without letters or of none go."""
    return keep_languages(docs, learn_languages(docs), LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; a document that loses all its words goes."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cleaned = dedup_lines(docs, 80, carry)
    kept = cleaned.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*(columns.get(c, F.col("carry")[c]).alias(c) for c in docs.columns))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: five words, 0.8 or more."""
    return one_of_each(docs, jaccard_components(docs, width=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return without_matches(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 token ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language labels and ids of tokens are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
