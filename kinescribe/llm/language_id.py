"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled text. Each task keeps one count per (language, bucket) and
emits the ones it has seen, so the shuffle carries at most languages x buckets rows per task whatever the
share of one language. The model is a matrix of at most ``MAX_LANGUAGES`` x ``BUCKETS`` numbers, which is
the proven bound of what is broadcast. Scoring takes the texts in slices of ``SLICE`` characters, looks up
the matrix row of each n-gram (a sparse product with a 0/1 matrix) and adds the rows per text.

Edge cases: a text that is null or has no letter gets ``und`` with score 0. Rows without text or language
teach nothing. A model without languages answers ``und`` for every text. Repeated rows count as often as
they occur. Equal scores go to the language that sorts first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe.llm.common import lazily, small_batches

UNKNOWN = "und"
MAX_LANGUAGES = 256
BUCKETS = 1 << 15
#: Lengths of the n-grams.
LENGTHS = (1, 2, 3)
#: Characters handled at a time.
SLICE = 1 << 19
#: Added to every count.
SMOOTHING = 0.5

_SPACE = np.uint32(32)


@dataclass(frozen=True)
class LanguageModel:
    """``log_probs`` has a row per bucket and a column per language."""

    languages: list[str]
    log_priors: np.ndarray
    log_probs: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def slices(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of consecutive texts: (text numbers, start of each, code points with non-letters as blanks).

    A slice holds about ``SLICE`` characters; a longer text is spread over several slices, which repeat the
    last characters of the one before, so that no n-gram is lost or counted twice.
    """
    numbers: list[int] = []
    starts: list[int] = []
    parts: list[str] = []
    size = 0
    keep = max(LENGTHS) - 1
    pad = " " * keep

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer((pad[:1] + "".join(parts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.array(numbers), np.array(starts), np.where(_letters()[codes], codes, _SPACE)

    for i, text in enumerate(texts):
        low = text.lower() if text else ""
        for at in range(0, max(len(low), 1), SLICE):
            piece = low[at : at + SLICE]
            numbers.append(i)
            starts.append(size)
            # The characters that belong to the next slice complete the n-grams which start in this one.
            parts.append(piece + (low[at + SLICE : at + SLICE + keep] + pad)[:keep])
            size += len(piece) + keep
            if size >= SLICE:
                yield done()
                numbers, starts, parts, size = [], [], [], 0
    if numbers:
        yield done()


def buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram at every place, for each length."""
    n = len(codes) - max(LENGTHS) + 1
    h = np.zeros(n, np.uint32)
    for k in range(max(LENGTHS)):
        h = (h + codes[k : k + n] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if k + 1 in LENGTHS:
            yield _mixed(h)


def _blank_buckets() -> list[int]:
    """Buckets of n-grams that consist of blanks only: they tell nothing."""
    return [int(b[0]) for b in buckets(np.full(max(LENGTHS), _SPACE))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lang in langs:
            rows[lang] = rows.get(lang, 0) + 1
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
        order = sorted(counts)
        place = {lang: i for i, lang in enumerate(order)}
        seen = np.zeros(len(order) * BUCKETS, np.int64)
        for numbers, starts, codes in slices(lazily(batch.column(0))):
            of = np.array([place[langs[i]] for i in numbers], np.int64) * BUCKETS
            n = len(codes) - max(LENGTHS) + 1
            base = np.repeat(of, np.diff(np.append(starts, n)))
            for b in buckets(codes):
                seen += np.bincount(base + b[: len(base)], minlength=len(seen))
        for lang, i in place.items():
            counts[lang] += seen[i * BUCKETS : (i + 1) * BUCKETS]
    for lang, found in counts.items():
        places = np.flatnonzero(found)
        yield pa.record_batch(
            [
                pa.array([lang] * (len(places) + 1), pa.string()),
                pa.array(np.append(places, -1), pa.int32()),
                pa.array(np.append(found[places], rows[lang]), pa.int64()),
            ],
            ["lang", "bucket", "n"],
        )


def train_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Naive Bayes model of all rows that have a text and a language."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    counted = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    try:
        priors = counted.where("bucket < 0").select("lang", "n").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
        if len(priors) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        # At most MAX_LANGUAGES x BUCKETS rows, checked above.
        cells = counted.where("bucket >= 0").toPandas()
    finally:
        counted.unpersist()
    languages = [r.lang for r in priors]
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    if languages:
        place = cells["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
        matrix[cells["bucket"].to_numpy(), place] += cells["n"].to_numpy()
        matrix = np.log(matrix / matrix.sum(axis=0))
        matrix[_blank_buckets()] = 0.0
    rows = np.array([r.n for r in priors], float)
    return LanguageModel(languages, np.log(rows / rows.sum()) if languages else rows, matrix.astype(np.float32))


def predictor(spark: SparkSession, model: LanguageModel):
    """Column function: text to a struct (lang_pred, score)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.log_priors, model.log_probs))

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        languages, priors, table = shared.value
        total = np.tile(priors, (len(texts), 1)) if languages else np.zeros((len(texts), 1))
        letters = np.zeros(len(texts), bool)
        for numbers, starts, codes in slices(lazily(texts)):
            n = len(codes) - max(LENGTHS) + 1
            has = np.logical_or.reduceat(codes[:n] != _SPACE, np.minimum(starts + 1, n - 1))
            np.logical_or.at(letters, numbers, has)
            if not languages:
                continue
            for b in buckets(codes):
                np.add.at(total, numbers, np.add.reduceat(table[b], starts, axis=0, dtype=np.float64))
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        sure = letters & bool(languages)
        score = np.where(sure, 1.0 / odds.sum(axis=1), 0.0)
        names = [languages[j] if ok else UNKNOWN for j, ok in zip(best, sure)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return predict


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (probability of that language); columns of that name are replaced."""
    found: Column = predictor(docs.sparkSession, model)(F.col(text).cast("string"))
    plain = docs.drop("lang_pred", "score")
    return plain.withColumn("_kinescribe_found", found).select(*plain.columns, "_kinescribe_found.lang_pred", "_kinescribe_found.score")


def drop_unidentified(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that have no language (``und``) or one with a probability below ``least``."""
    found = F.col("_kinescribe_found")
    marked = docs.withColumn("_kinescribe_found", predictor(docs.sparkSession, model)(F.col(text).cast("string")))
    return marked.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least)).select(*docs.columns)
