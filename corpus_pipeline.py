"""From raw documents to packed training sequences, as five written stages.

language ID -> quality classifier -> n-gram Jaccard join -> substring dedup -> packing.
Each stage reads all that its predecessor kept; all but the last return the columns of
documents, whatever other columns are called. Null ids, repeated ids and repeated rows are rows
like all others; an empty table gives an empty one.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import jaccard, language, packing, quality, substring_dedup
from barloom.llm.common import crc_mod, table
from barloom.session import shared_dir

#: A text is rejected as of no language without a letter, or below this posterior.
LANGUAGE_SCORE = 0.5


def with_numbered_columns(docs: DataFrame, stage: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """``stage`` on the documents with all columns but doc_id and text under numbers, so that no name clashes with one it makes."""
    names = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    made = stage(plain, tuple(n for n in names.values() if n not in ("doc_id", "text")))
    return made.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of a language found; learns from the stage's own labelled rows.

    Null texts and texts without a letter go. Without any labelled row all texts with a letter stay.
    """
    model = language.fit_languages(docs.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))))
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))

    def stage(plain: DataFrame, rest: tuple[str, ...]) -> DataFrame:
        found = language.identify_languages(plain, model, carry=rest, with_text=True)
        return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE))

    return with_numbered_columns(docs, stage)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents predicted good; without any labelled row every score is 0.5 and all stay."""
    weights = quality.fit_quality(docs.where(F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False))), table(spark, sf_dir, "labels"))
    return with_numbered_columns(docs, lambda plain, rest: quality.score_quality(plain, weights, carry=rest, with_text=True).where(F.col("score") >= quality.THRESHOLD))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: one row of each component stays, the one of the smallest doc_id.

    Rows are judged each for itself, also where they share a doc_id; null and empty texts stay.
    """
    return jaccard.keep_one(docs, words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in an earlier document are cut out; every document stays, with the text left to it (null becomes empty)."""
    kept = with_numbered_columns(docs, lambda plain, rest: substring_dedup.remove_repeats(plain, carry=rest, with_text=True).withColumn("text", F.col("kept_text")))
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their places in sequences of 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Models, components and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
