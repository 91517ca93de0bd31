"""The corpus pipeline: toxic documents and those of unknown language go, one of each group of near copies stays, the rest is packed.

Every stage works on all rows and whole texts that its predecessor kept. All but the last return the columns of documents as
they came, whatever their names; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeline.llm import language_bloom, near_dup, packing, toxicity_fm
from lakeline.llm.common import written
from lakeline.llm.queries import language_model, toxicity_model

#: Percent of their shingles that near copies share (85 is op10's own contract).
SIMILARITY = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the factorization machine scores 0.5 or more; it learns from labels of docs that are not held out.

    Null and empty texts get the machine's bias alone, and so stay unless most labelled rows are toxic; repeated rows and
    rows without an id are judged by their text like any other; without usable labels all stay.
    """
    return toxicity_fm.reject(docs, toxicity_model(docs, sf_dir))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of unknown language, or with under 0.3 of their n-grams in their language's filter (of which weak hits count a tenth).

    Null and empty texts and texts without a letter have no language and go; ties between languages don't matter, as either
    has the same share; rows without `lang` teach nothing; without any row that does, no language is known and all go.
    """
    return language_bloom.reject(docs, language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose class of near copies (five-word shingles, similarity 0.8) has a smaller id.

    Null and empty texts and rows without an id are in no class and stay; rows that share their id stay together.
    """
    return near_dup.keep_one(docs, percent=SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of 2048 tokens: a null or empty text is its end id alone, a long one is cut into many
    pieces, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Model scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
