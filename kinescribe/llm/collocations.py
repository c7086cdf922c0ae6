"""Phrase collocations by set-oriented mining: sorted occurrence relations that are extended word by word.

1. Texts are cut into pieces and words. A chunk holds the occurrences of about ``CHUNK`` words of one language: the word at every
   position, with an empty position between pieces, so that adjacent positions always are in one piece. Chunks are written once.
2. For each length: the occurrences of a chunk are grouped by the 64-bit hash of their phrase, and the counts of all chunks are summed by
   ranges of hashes, one range per shuffle partition; sorted hashes travel as the steps between them. The hashes that occur often enough
   become a bitmap, with which a chunk's sorted positions are semi-joined. Of the chunks that hold a phrase, the one with the smallest
   hash of (phrase, chunk) spells it; a second bitmap has the bits of these hashes. Spelled phrases are joined with the sums, so bits
   shared by several phrases are no matter.
3. The positions that passed are merge-joined with the positions of frequent words that follow them, which gives the occurrences of the next
   length. Words that are in no frequent phrase leave the relation. It is written before the next length begins.

Scores, cuts and the containment of phrases are joins of the tables of counts. Nothing but the two bitmaps (``BITMAP_BITS`` each; with very
many frequent phrases they pass more rows, but no fewer) is shared with tasks, and chunks bound what a task holds.

Edge cases: a null text is empty, a null language is ``und``. Words hold no blank, tab or mark that ends a piece, so a phrase is split
at its blanks. Repeated rows count as often as they occur. A very long text makes a chunk of its own size. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.llm.common import batches, lazily, stage
from kinescribe.llm.word_hashes import mixed

LONGEST, SUPPORT, BEST = 4, 30, 2000
#: Least share of a phrase's occurrences, in hundredths, with which a longer phrase replaces it.
COVERED = 80
SCALE = 2_000_000
CHUNK = 1 << 20
#: Counts that a task reads before it sums them.
ROWS = 1 << 20
BITMAP_BITS = 1 << 26
#: Parts of a language's phrases that are ranked on their own before the best of all parts are.
RANK_PARTS = 1 << 8

_BORDERS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_P = np.uint64(0x9E3779B97F4A7C15)
#: hash of the chunk, lang, words (joined by blanks), word at each position (32-bit numbers, -1: none), bits of the positions where phrases
#: start, phrases one word shorter that this chunk spells and their hashes, number of words.
_CHUNK = "chunk long, lang string, words binary, tokens binary, starts binary, phrases array<string>, hashes array<long>, n long"
_FIELDS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("tokens", pa.binary()), ("starts", pa.binary()), ("phrases", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64())), ("n", pa.int64())])


def _chunk(chunk: int, lang: str, words: list[bytes], tokens: np.ndarray, at: np.ndarray, phrases: list[str], hashes: np.ndarray, n: int) -> pa.RecordBatch:
    starts = np.zeros(len(tokens), bool)
    starts[at] = True
    columns = [chunk], [lang], [b" ".join(words)], [tokens.astype("<i4").tobytes()], [np.packbits(starts).tobytes()], [phrases], [hashes.view(np.int64)], [n]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[bytes], np.ndarray, np.ndarray]]:
    """(chunk, lang, words, word at each position, sorted starts) of chunks."""
    for batch in batches:
        for i in range(len(batch)):
            tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), "<i4").astype(np.int64)
            starts = np.unpackbits(np.frombuffer(batch.column("starts")[i].as_buffer(), np.uint8), count=len(tokens))
            words = batch.column("words")[i].as_py()
            yield batch.column("chunk")[i].as_py(), batch.column("lang")[i].as_py(), words.split(b" ") if words else [], tokens, np.flatnonzero(starts)


def _occurrences(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the words of (lang, text)."""
    held: dict[str, tuple[dict[bytes, int], list[int]]] = {}
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        for lang, (known, tokens) in held.items():
            places = np.array(tokens, np.int64) - 1
            at = np.flatnonzero(places >= 0)
            # Numbered when it is written.
            yield _chunk(0, lang, list(known)[1:], places, at, [], np.zeros(0, np.uint64), len(at))

    for batch in rows:
        for lang, text in zip(lazily(batch.column(0)), lazily(batch.column(1))):
            # The mark "." stands for every border; it is in no word.
            parts = (text or "").encode("utf-8", "replace").translate(_BORDERS).lower().replace(b"\n", b" . ").split()
            known, tokens = held.setdefault(lang, ({b".": 0}, []))
            tokens += [known.setdefault(w, len(known)) for w in parts]
            tokens.append(0)
            size += len(parts) + 1
            if size >= CHUNK:
                yield from done()
                held, size = {}, 0
    yield from done()


def _hashes(lang: str, words: list[bytes], tokens: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the phrase of ``length`` words at each of the positions."""
    seed = xxhash.xxh64_intdigest(lang)
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w, seed) for w in words], np.uint64)
    h = np.full(len(at), length, np.uint64)
    for k in range(length):
        h = h * _P + own[tokens[at + k]]
    return mixed(h)


def _keys(chunk: int, hashes: np.ndarray) -> np.ndarray:
    """Hash of (phrase, chunk) for each hash of a phrase; the smallest of a phrase tells the chunk that spells it."""
    return mixed(hashes ^ np.uint64(chunk & ((1 << 64) - 1)))


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: first the lowest byte of each, so that those that are zero lie together and are compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _counter(length: int, parts: int):
    """Function from chunks to (part, chunk, steps between sorted hashes, occurrences in the chunk); a part is a range of hashes."""
    edges = np.array([(1 << 64) * p // parts for p in range(1, parts)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, lang, words, tokens, at in _chunks(batches):
            found, n = np.unique(_hashes(lang, words, tokens, at, length), return_counts=True)
            cuts = [0, *np.searchsorted(found, edges).tolist(), len(found)]
            rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            steps = [_planes(np.diff(found[a:b], prepend=np.uint64(0))) for _, a, b in rows]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(steps, pa.binary()), pa.array([_planes(n[a:b]) for _, a, b in rows], pa.binary())], ["part", "chunk", "steps", "n"])

    return count


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray], keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    if not len(first):
        return every, every, every
    return every[first], np.add.reduceat(np.concatenate(counts)[order], first), np.minimum.reduceat(np.concatenate(keys)[order], first)


def _adder(support: int):
    """Function from the rows of some parts to (h, f, smallest key) of the hashes that occur ``support`` times."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        hashes, counts, keys, size = [none], [none], [none], 0
        for batch in batches:
            for chunk, steps, n in zip(batch.column("chunk").to_pylist(), batch.column("steps"), batch.column("n")):
                hashes.append(np.cumsum(_numbers(steps.as_py()), dtype=np.uint64))
                counts.append(_numbers(n.as_py()))
                keys.append(_keys(chunk, hashes[-1]))
                size += len(counts[-1])
                # What is held at least doubles between two sums, so each number is summed a few times only.
                if size > max(ROWS, len(counts[0])):
                    merged = _summed(hashes, counts, keys)
                    hashes, counts, keys, size = [merged[0]], [merged[1]], [merged[2]], 0
        found, total, least = _summed(hashes, counts, keys)
        often = total >= support
        yield pa.record_batch([pa.array(found[often].view(np.int64)), pa.array(total[often].astype(np.int64)), pa.array(least[often].view(np.int64))], ["h", "f", "key"])

    return add


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    bit = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _extender(length: int, longest: int, bitmaps):
    """Function from chunks of phrases of ``length`` words to chunks of phrases one word longer, with the phrases that the chunk spells."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, spelling = bitmaps.value
        for chunk, lang, words, tokens, at in _chunks(batches):
            h = _hashes(lang, words, tokens, at, length)
            passed = _has(frequent, h)
            at, h = at[passed], h[passed]
            found, first = np.unique(h, return_index=True)
            own = _has(spelling, _keys(chunk, found))
            spelled = tokens[at[first[own]][:, None] + np.arange(length)]
            phrases = [b" ".join([words[t] for t in row]).decode("utf-8", "replace") for row in spelled.tolist()]
            # Words that are in a phrase stay.
            inside = np.zeros(len(tokens), bool)
            for k in range(length if length < longest else 0):
                inside[at + k] = True
            kept = np.unique(tokens[inside])
            place = np.full(len(words) + 1, -1, np.int64)
            place[kept] = np.arange(len(kept))
            left = np.where(inside, place[tokens], -1)
            # The merge-join: sorted starts of phrases, and sorted positions of words that follow.
            longer = np.intersect1d(at, np.flatnonzero(left >= 0) - length, assume_unique=True)
            # Of several empty positions one is enough.
            stays = (left >= 0) | (np.concatenate([[0], left[:-1]]) >= 0)
            yield _chunk(chunk, lang, [words[i] for i in kept.tolist()], left[stays], (np.cumsum(stays) - 1)[longer], phrases, found[own], 0)

    return extend


def _bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bytes of a bitmap in which the bit of every hash in a column is set."""
    # Spark's buckets hold the numbers from 1 on.
    bit = F.col(column).bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1
    found = hashes.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bits = np.zeros(max(1, BITMAP_BITS >> 15) << 12, np.uint8)
    # At most BITMAP_BITS / 32768 rows of 4 KB, in one job: an iterator would run one for every partition.
    for row in found.collect():
        at = (row.bucket - 1) << 12
        bits[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return bits[: BITMAP_BITS >> 3]


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of up to ``longest`` words that occur ``support`` times, and (lang, n): the words of each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    found = None
    with batches(spark):
        chunks = stage(rows.mapInArrow(_occurrences, _CHUNK).withColumn("chunk", F.xxhash64(F.monotonically_increasing_id())))
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for length in range(1, longest + 1):
        # A chunk is a row of megabytes.
        with batches(spark, 8):
            counted = chunks.select("chunk", "lang", "words", "tokens", "starts").mapInArrow(_counter(length, parts), "part int, chunk long, steps binary, n binary")
            often = stage(counted.repartition(parts, "part").mapInArrow(_adder(support), "h long, f long, key long"))
            bitmaps = spark.sparkContext.broadcast((_bitmap(often, "h"), _bitmap(often, "key")))
            chunks = stage(chunks.select("chunk", "lang", "words", "tokens", "starts").mapInArrow(_extender(length, longest, bitmaps), _CHUNK))
        told = chunks.select("lang", F.inline(F.arrays_zip(F.col("phrases").alias("phrase"), F.col("hashes").alias("h"))).alias("phrase", "h"))
        exact = told.distinct().join(often.select("h", "f"), "h")
        exact = stage(exact.select("lang", "phrase", F.lit(length).alias("length"), "f"))
        found = exact if found is None else found.union(exact)
    return found, totals


def _part(words, first, size):
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT, best: int = BEST) -> DataFrame:
    """The ``best`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words with ``a`` occurrences is cut after each word: ``l`` and ``r`` are the occurrences of the parts, the score
    is floor(SCALE * a / (l + r)), and the cut of the lowest score counts, of equal ones the first. A phrase that lies in a longer one with
    at least ``COVERED`` hundredths of its occurrences is left out.
    """
    found, totals = frequent_phrases(docs, text, lang, longest, support)
    phrases = found.where("length > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _part(F.col("w"), F.lit(1), F.col("k"))).withColumn("rest", _part(F.col("w"), F.col("k") + 1, F.col("length") - F.col("k")))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # Whole numbers of up to 38 digits.
    score = F.expr(f"(CAST(f AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("f").alias("a"))

    inner = phrases.where("length > 2").select("lang", "w", "length", "f", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", _part(F.col("w"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left")
    left = left.where(F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {COVERED}"))
    left = left.join(totals, "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    # A language may have most of the phrases: the best of each of its parts are ranked first.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    order = Window.partitionBy("lang").orderBy(*order)
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
