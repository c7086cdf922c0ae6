"""From documents to packed windows: language ID, exact and near deduplication, decontamination, packing.

Every stage is a function of (spark, docs, sf_dir) and reads what the stage before wrote. The first four return rows of
their input with its columns; the last returns the pieces of the windows with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinescribe.llm import decontaminate, exact_dedup, language_id, packing, simhash
from kinescribe.llm.common import read, stage

#: Runs whose ids a worker remembers in packing: an eighth of the default, as executor and workers still hold memory of the stages before.
REMEMBERED = 1 << 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model is trained on those whose language is given."""
    return language_id.drop_unidentified(docs, language_id.train_languages(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group that is equal but for white space."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of "at least 0.8 of the five-word shingles are shared"."""
    return simhash.drop_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 2048 ids."""
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("language ID", identify_language), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated), ("packing", pack_windows),
]

#: Neither shingle sets nor token ids can be written in SQL; tests compare with a plain program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
