"""Listing of saved analyses, and the category lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe.functions.scalars import day_label

#: Names of the categories.
CATEGORY_NAMES = (
    "Usability Issue / Bug", "Feature Request", "Positive Feedback", "Instruction / Walkthrough", "Visual Design", "General / Irrelevant",
)
#: A few starting terms per category, in the order of the names; projects bring their own lexicon as a file.
STARTING_TERMS = (
    ("stutters", "freezes", "unresponsive", "laggy", "workaround"),
    ("shortcut", "export option", "please offer", "plug-in", "integration"),
    ("enjoyable", "smooth", "delightful", "pleasing", "intuitive"),
    ("begin by", "afterwards", "pick up", "scroll down", "finally"),
    ("palette", "spacing", "contrast", "typeface", "alignment"),
    ("weather", "lunch", "weekend", "coffee break", "microphone check"),
)
DEFAULT_LEXICON = {name: list(terms) for name, terms in zip(CATEGORY_NAMES, STARTING_TERMS)}


def display_name(file_name: Column) -> Column:
    """Name of the recording: the text before "_Analysis_", or the middle of "Analysis_<name>_<d>_<t>"."""
    stem = F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", "")
    old = F.regexp_extract(stem, r"^Analysis_(.+)_[^_]+_[^_]+$", 1)
    return (
        F.when(stem.contains("_Analysis_"), F.substring_index(stem, "_Analysis_", 1)).when(old != "", old).otherwise(file_name)
    )


def list_library(spark: SparkSession, root: str, today: Column | None = None, pattern: str = "*") -> DataFrame:
    """Saved files, newest first, with day label, time and display name. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    named = files.select("path", "modificationTime", "length", F.element_at(F.split("path", "/"), -1).alias("file_name"))
    day = F.to_date("modificationTime")
    return named.select(
        "path", "file_name", display_name(F.col("file_name")).alias("display_name"),
        day_label(day, today if today is not None else F.current_date()).alias("day_label"),
        F.date_format("modificationTime", "HH:mm").alias("time"), "modificationTime", "length",
    ).orderBy(F.col("modificationTime").desc(), "file_name")


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_LEXICON.items()), "category string, terms array<string>")


def read_lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Categories and terms from a JSON object {category: [terms]}; the built-in lexicon if there is none."""
    if path is None:
        return default_lexicon(spark)
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "terms"))
    return default_lexicon(spark) if parsed.isEmpty() else parsed


def lexicon_terms(lexicon: DataFrame) -> DataFrame:
    """One row per category and term."""
    return lexicon.select("category", F.explode("terms").alias("term"))
