"""Words, sentences, transcript chunks, search and keywords."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from kinescribe.operators.lookups import overlapping
from kinescribe.plans.chunks import CHUNK, chunk_of, dense_index, in_chunks, ordered

#: Fixed values of the sentence rules.
SENTENCE_END = r"[.!?]$"
GAP_S, GAP_LENGTH, MAX_LENGTH = 1.0, 30, 250
#: A sentence spans at most this many words: each adds two or more to the length.
LOOKAHEAD = MAX_LENGTH // 2 + 3

#: Fixed value: fillers that mark a short segment as noise.
FILLERS = ("i'm sorry", "didn't get that", "thank you", "okay", "yeah", "yes", "um", "uh", "no")

#: English function words by word class, left out of keyword sets (a parameter of the operators).
_ARTICLES = "a an the this that these those each every either neither another such both several many much few more most less least any some all none"
_PRONOUNS = "i me my mine myself we us our ours ourselves you your yours yourself he him his himself she her hers herself it its itself they them their theirs"
_QUESTIONS = "who whom whose which what where when why how"
_AUXILIARIES = "am is are was were be been being have has had having do does did doing can could may might must shall should will would cannot"
_PREPOSITIONS = "about above across after against along among around at before behind below beneath beside between beyond by down during for from in into near of off on onto over past since through to toward under until up upon with within without"
_CONJUNCTIONS = "and but or nor so yet if unless because although though while whereas whether than as"
_ADVERBS = "not no never always often again already almost also even ever here there now then soon still only too very quite rather perhaps however therefore once"
STOP_WORDS = " ".join((_ARTICLES, _PRONOUNS, _QUESTIONS, _AUXILIARIES, _PREPOSITIONS, _CONJUNCTIONS, _ADVERBS)).split()


# --- chunks ------------------------------------------------------------------------------------------

def chunk_bounds(sessions: DataFrame, chunk_s: float = 300.0, overlap_s: float = 2.0) -> DataFrame:
    """Core and extract interval of every transcription chunk. ``sessions``: session_id, duration_s."""
    last = F.ceil(F.col("duration_s") / chunk_s).cast("int") - 1
    numbered = sessions.where(F.col("duration_s") > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_idx") * chunk_s
    end = F.least(F.col("duration_s"), start + chunk_s)
    return numbered.select(
        "session_id", "chunk_idx", start.alias("core_start"), end.alias("core_end"),
        F.greatest(F.lit(0.0), start - overlap_s).alias("extract_start"),
        F.least(F.col("duration_s"), end + overlap_s).alias("extract_end"),
    )


def normalised(text: Column) -> Column:
    """Lower-cased text with single spaces and no punctuation, for comparing repeated segments."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def stitch_chunks(segments: DataFrame, chunk_s: float = 300.0, overlap_s: float = 2.0) -> DataFrame:
    """Segments of overlapping chunks on one clock, without those an earlier chunk already has.

    ``segments``: session_id, chunk_idx, start_s, end_s (from the start of the chunk's extract), text. A
    segment counts as repeated if the same text was found by an earlier chunk at an overlapping time; that
    can only happen near a chunk border, so only those segments are compared.
    """
    core = F.col("chunk_idx") * chunk_s
    offset = F.greatest(F.lit(0.0), core - overlap_s)
    timed = segments.withColumns({"start_s": F.col("start_s") + offset, "end_s": F.col("end_s") + offset})
    inside = timed.where((F.col("end_s") > core) & (F.col("start_s") < core + chunk_s))
    keyed = inside.withColumn("_text", normalised(F.col("text")))
    early = keyed.where(F.col("end_s") > core + chunk_s - overlap_s).select(
        "session_id", "_text", F.col("chunk_idx").alias("_chunk"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e")
    )
    late = keyed.where((F.col("start_s") < core + overlap_s) & (F.col("chunk_idx") > 0)).select(
        "session_id", "_text", "chunk_idx", "start_s", "end_s"
    )
    pairs = overlapping(late, early, ["session_id", "_text"], ("start_s", "end_s"), ("_s", "_e"), chunk_s)
    same = ["session_id", "_text", "chunk_idx", "start_s", "end_s"]
    repeated = pairs.where(F.col("_chunk") < F.col("chunk_idx")).select(*same)
    return keyed.join(repeated, same, "left_anti").drop("_text")


# --- sentences ---------------------------------------------------------------------------------------

def sentence_ends() -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Function giving the index of the last word of a sentence that starts at each word.

    Built on the driver so that it travels to the executors by value.
    """
    def ends(hard: np.ndarray, gap: np.ndarray, length: np.ndarray) -> np.ndarray:
        n = len(length)
        before = np.concatenate([[0], np.cumsum(length)])

        def following(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
            spots = np.append(np.flatnonzero(flags), n)
            return spots[np.searchsorted(spots, start)]

        here = np.arange(n)
        longer = lambda limit: np.searchsorted(before, before[:-1] + limit, side="right") - 1
        pause = following(gap, np.maximum(here, np.minimum(longer(GAP_LENGTH), n)))
        return np.minimum(np.minimum(following(hard, here), longer(MAX_LENGTH)), np.minimum(pause, n - 1))

    return ends


def words_to_sentences(words: DataFrame, order: Sequence[str], bucket: Column, rows: int = 262_144) -> DataFrame:
    """Timed words to sentences.

    A sentence ends at . ! ?, before a pause of more than one second once it is longer than 30 characters,
    beyond 250 characters, and with the last word. ``words``: session_id, word, start_s, end_s and the
    ``order`` columns; ``bucket`` see :func:`dense_index`.

    Where a sentence starts depends on all sentences before it. Long sessions are therefore cut into chunks
    of words: a first pass finds, for every word a chunk could be entered at, the word at which the next
    chunk is entered; following these small maps gives each chunk's entry, and a second pass splits all
    chunks in parallel. Sessions that fit one chunk need no first pass.
    """
    def flags(df: DataFrame, by: list[str]) -> DataFrame:
        pause = F.lead("start_s").over(ordered(by, "_pos")) - F.col("end_s")
        return df.withColumn("gap", F.coalesce(pause > GAP_S, F.lit(False)))

    placed = dense_index(words, ["session_id"], bucket, order, "_pos")
    flagged = in_chunks(placed, ["session_id"], "_pos", flags, 0, 1, rows).withColumn("word", F.trim("word"))
    kept = flagged.where(F.length("word") > 0)
    numbered = dense_index(kept, ["session_id"], chunk_of("_pos", rows), ["_pos"], "n", "words").select(
        "session_id", "n", "words", "word", "start_s", "end_s", "gap",
        F.col("word").rlike(SENTENCE_END).alias("hard"), (F.length("word") + 1).alias("size"),
    )
    ends = _sentence_of(numbered, rows)
    return (
        ends.groupBy("session_id", "last_n")
        .agg(
            F.min_by("start_s", "n").alias("start_s"), F.max_by("end_s", "n").alias("end_s"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda w: w["word"]), " ").alias("text"),
        )
        .withColumn("sentiment", F.lit("Neutral"))
    )


def _runs(keys: Sequence[str], work: Callable[[tuple, dict], dict], names: Sequence[str]) -> Callable:
    """Function for ``mapInPandas`` over rows sorted by ``keys``: ``work`` on each run of equal keys, one result per batch.

    What may go on in the next batch waits, so a task holds a batch and one run. Keys are compared as texts; NULL is a key.
    """
    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        new[:1] = True
        for c in keys:
            column = pdf[c].to_numpy()
            empty = pd.isna(column)
            new[1:] |= ((column[1:] != column[:-1]) & ~(empty[1:] & empty[:-1])).astype(bool)
        return np.flatnonzero(new)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            edges = [*starts(pdf).tolist(), len(pdf)]
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            parts = [work(tuple(columns[c][a] for c in keys), {c: v[a:b] for c, v in columns.items()}) for a, b in zip(edges, edges[1:])]
            joined = {c: [part[c] for part in parts] for c in names}
            return pd.DataFrame({c: np.concatenate(v) if isinstance(v[0], np.ndarray) else [x for part in v for x in part] for c, v in joined.items()})

        for pdf in batches:
            if not len(pdf):
                continue
            last = int(starts(pdf)[-1])
            goes_on = bool(waiting) and len(starts(pd.concat([waiting[0].tail(1), pdf.head(1)]))) == 1
            if waiting and not (goes_on and last == 0):
                first = int(starts(pdf)[1]) if goes_on and last else 0
                yield done(pd.concat([*waiting, pdf.iloc[:first]], ignore_index=True))
                pdf, waiting = pdf.iloc[first:], []
                last = int(starts(pdf)[-1])
            if last:
                yield done(pdf.iloc[:last])
            waiting.append(pdf.iloc[last:])
        if waiting:
            yield done(pd.concat(waiting, ignore_index=True))

    return over


def _sentence_of(numbered: DataFrame, rows: int) -> DataFrame:
    """Adds ``last_n``, the number of the last word of each word's sentence.

    A task goes through all its chunks, sorted, in one call: a call per chunk would cost more than a chunk of few words.
    """
    key = numbered.schema["session_id"]
    # Copies of the next chunk's first words let every sentence that starts in a chunk be seen to its end.
    home = chunk_of("n", rows)
    spread = F.when((F.pmod("n", F.lit(rows)) < LOOKAHEAD) & (home > 0), F.array(home - 1, home)).otherwise(F.array(home))
    seen = numbered.withColumn("session_id", F.col("session_id").cast("string")).withColumn(CHUNK, F.explode(spread))
    find_ends = sentence_ends()

    def exits(part: tuple, own: dict) -> dict:
        core = int((own["n"] < (part[1] + 1) * rows).sum())
        nxt = (find_ends(own["hard"], own["gap"], own["size"]) + 1).tolist()
        out = [0] * core
        for i in range(core - 1, -1, -1):
            out[i] = nxt[i] - core if nxt[i] >= core else out[nxt[i]]
        return {"session_id": [part[0]], CHUNK: [part[1]], "exits": [out[:LOOKAHEAD]]}

    def follow(part: tuple, own: dict) -> dict:
        entry, entries = 0, []
        for chunk_exits in own["exits"]:
            entries.append(entry)
            entry = int(chunk_exits[min(entry, len(chunk_exits) - 1)])
        return {"session_id": [part[0]] * len(entries), CHUNK: own[CHUNK].tolist(), "entry": entries}

    def split(part: tuple, own: dict) -> dict:
        core = int((own["n"] < (part[1] + 1) * rows).sum())
        end = find_ends(own["hard"], own["gap"], own["size"]).tolist()
        start, last = int(own["entry"][0]), np.empty(core, dtype="int64")
        last[:start] = start - 1
        while start < core:
            last[start : end[start] + 1] = end[start]
            start = end[start] + 1
        return {**{c: own[c][:core] for c in ("session_id", *kept)}, "last_n": last + int(part[1] * rows)}

    def in_runs(df: DataFrame, keys: list[str], order: str, work: Callable, fields: list[StructField]) -> DataFrame:
        placed = df.repartition(*keys).sortWithinPartitions(*dict.fromkeys([*keys, order]))
        return placed.mapInPandas(_runs(keys, work, [f.name for f in fields]), StructType(fields))

    kept = ["n", "word", "start_s", "end_s"]
    as_map = [StructField("session_id", StringType()), StructField(CHUNK, LongType())]
    long = seen.where(F.col("words") > rows).select("session_id", CHUNK, "n", "hard", "gap", "size")
    maps = in_runs(long, ["session_id", CHUNK], "n", exits, [*as_map, StructField("exits", ArrayType(LongType()))])
    entries = in_runs(maps, ["session_id"], CHUNK, follow, [*as_map, StructField("entry", LongType())])
    entries = entries.withColumnsRenamed({"session_id": "_session", CHUNK: "_of"})
    same = seen["session_id"].eqNullSafe(F.col("_session")) & (seen[CHUNK] == F.col("_of"))
    entered = seen.join(entries, same, "left").withColumn("entry", F.coalesce("entry", F.lit(0).cast("bigint")))
    entered = entered.select("session_id", CHUNK, *kept, "hard", "gap", "size", "entry")
    fields = [as_map[0], *[numbered.schema[c] for c in kept], StructField("last_n", LongType())]
    return in_runs(entered, ["session_id", CHUNK], "n", split, fields).withColumn("session_id", F.col("session_id").cast(key.dataType))


# --- filters and search ------------------------------------------------------------------------------

def segment_filter(segments: DataFrame, min_chars: int = 10) -> DataFrame:
    """Segments longer than ``min_chars`` characters."""
    return segments.where(F.length("text") > min_chars)


def is_noise(text: Column, fillers: Sequence[str] = FILLERS) -> Column:
    """Shorter than 15 characters and containing a filler anywhere."""
    clean = F.lower(F.trim(text))
    hit = F.lit(False)
    for phrase in fillers:
        hit = hit | clean.contains(phrase)
    return (F.length(clean) < 15) & hit


def noise_filter(segments: DataFrame, fillers: Sequence[str] = FILLERS) -> DataFrame:
    return segments.where(~is_noise(F.col("text"), fillers))


def search_segments(segments: DataFrame, text: str, hidden_topics: Sequence[int] = (), bucket: int = 65_536) -> DataFrame:
    """Segments containing ``text`` in any case, without hidden topics, numbered from 1 in transcript order."""
    found = segments.where(F.instr(F.lower("text"), text.lower()) > 0)
    if hidden_topics:
        found = found.where(~F.col("topic").isin(*hidden_topics))
    ranked = dense_index(found, ["session_id"], chunk_of("seg_idx", bucket), ["seg_idx"], "_n", "matches")
    return ranked.withColumn("match_no", F.col("_n") + 1).drop("_n")


def topic_visibility(segments: DataFrame, focus: int | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """Only the ``focus`` topic, or all but the topics of ``hidden`` (a table with a column topic)."""
    if focus is not None:
        return segments.where(F.col("topic") == focus)
    return segments if hidden is None else segments.join(hidden.select("topic").distinct(), "topic", "left_anti")


# --- keywords ----------------------------------------------------------------------------------------

def tokens(segments: DataFrame) -> DataFrame:
    """Lower-cased words between white space, with their place in the session."""
    return segments.select(
        "session_id", "seg_idx", F.posexplode(F.split(F.lower("text"), r"(?U)\s+")).alias("i", "word")
    ).where(F.col("word") != "")


def summary_keywords(segments: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent words longer than three letters per session (ties: first said), and the
    number of such words."""
    long_words = tokens(segments).where(F.length("word") > 3)
    counts = long_words.groupBy("session_id", "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seg_idx", "i")).alias("first")
    )
    over = ordered(["session_id"], F.col("n").desc(), "first")
    best = counts.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    totals = counts.groupBy("session_id").agg(F.sum("n").alias("total_words"))
    return best.join(totals, "session_id").select("session_id", "rank", "word", "n", "total_words")


def clean_words(segments: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Distinct words of a session without punctuation, stop words and words of one or two letters."""
    plain = segments.withColumn("text", F.regexp_replace("text", r"[^\p{L}\p{N}_\s]", ""))
    words = tokens(plain).where((F.length("word") > 2) & ~F.col("word").isin(*stop_words))
    return words.select("session_id", "word").distinct()


def export_segments_json(transcript: DataFrame) -> DataFrame:
    """One JSON object per segment: id, start, end, text, topic (default "General")."""
    topic = F.coalesce("topic", F.lit("General")) if "topic" in transcript.columns else F.lit("General")
    return transcript.select(
        "session_id",
        F.to_json(
            F.struct(
                F.col("seg_idx").alias("id"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text",
                topic.alias("topic"),
            )
        ).alias("segment"),
    )
