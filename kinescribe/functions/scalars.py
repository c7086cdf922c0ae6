"""Small column expressions: time, text, labels, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- time --------------------------------------------------------------------------------------------

def safe_fps(fps: Column) -> Column:
    """Frame rate, 30 where missing or not positive."""
    return F.when(fps > 0, fps).otherwise(F.lit(30.0))


def frame_time(frame_idx: Column, fps: Column) -> Column:
    return frame_idx / safe_fps(fps)


def frame_ms(frame_idx: Column, fps: Column) -> Column:
    """Whole milliseconds of a frame."""
    return (frame_idx * F.lit(1000.0) / safe_fps(fps)).cast("bigint")


def format_duration(seconds: Column) -> Column:
    """45s, 2m 14s, 1h 3m."""
    whole = seconds.cast("bigint")
    hours, minutes = F.floor(whole / 3600), F.floor(whole / 60)
    return (
        F.when(whole < 60, F.format_string("%ds", whole))
        .when(whole < 3600, F.format_string("%dm %ds", minutes, whole % 60))
        .otherwise(F.format_string("%dh %dm", hours, minutes % 60))
    )


def clock(seconds: Column) -> Column:
    """mm:ss (minutes keep counting beyond an hour)."""
    whole = F.floor(seconds)
    return F.concat(
        F.lpad(F.floor(whole / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")
    )


def day_label(day: Column, today: Column) -> Column:
    """Today (May 03), Yesterday (May 02) or May 01, 2024."""
    age = F.datediff(today, day)
    near = lambda name: F.concat(F.lit(name + " ("), F.date_format(day, "MMMM dd"), F.lit(")"))
    return F.when(age == 0, near("Today")).when(age == 1, near("Yesterday")).otherwise(F.date_format(day, "MMMM dd, yyyy"))


# --- text --------------------------------------------------------------------------------------------

def shorten(text: Column, limit: int) -> Column:
    """Text cut to ``limit`` characters with an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def singular(word: Column) -> Column:
    """Word without trailing s."""
    return F.regexp_replace(word, "s+$", "")


def beautify_label(label: Column) -> Column:
    """"new_car_is_big" -> "New Car Big": parts longer than two letters, capitalised, the first three."""
    parts = F.filter(F.split(label, "_"), lambda w: F.length(w) > 2)
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    words = F.transform(F.slice(parts, 1, 3), capital)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise("Topic")


#: Fixed value: words that point at something shown.
DEICTIC = ("this", "that", "here", "there", "these", "those")


def deictic_terms(text: Column) -> Column:
    """Pointing words in order, as they stand between white space (punctuation is not stripped)."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w.isin(*DEICTIC))


# --- vectors -----------------------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector is empty or has zero length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v))
