"""Interval joins and point-in-time lookups.

All joins are equi-joins on the session and a cell of time. Cells come in levels: on each level they are twice as long as on the one
below. An interval is listed on the lowest level whose cells are at least as long as itself, where it touches two cells at most, and on
those higher levels on which the other side has intervals. A pair meets on the higher of its two levels and is kept only in the
cell in which the later of the two starts. So an interval of any length has few copies, and a long session is spread over its cells instead
of being joined in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.operators.traces import KEYS
from kinescribe.plans.chunks import in_chunks, ordered, small_list

BUCKET_S = 60.0


#: Levels of cells; those of the highest are BUCKET_S * 2^40 seconds long.
MOST_LEVELS = 40


def _cell(t: Column | str, level: Column, seconds: float) -> Column:
    """Number of the cell of a time."""
    col = F.col(t) if isinstance(t, str) else t
    return F.floor(col / (F.lit(seconds) * F.pow(F.lit(2.0), level))).cast("bigint")


def _level(start: str, end: str, seconds: float) -> Column:
    """Lowest level whose cells are at least as long as the interval."""
    length = F.greatest(F.lit(1.0), (F.col(end) - F.col(start)) / seconds)
    return F.least(F.lit(MOST_LEVELS), F.ceil(F.log2(length))).cast("int")


def levels_of(df: DataFrame, start: str, end: str, seconds: float = BUCKET_S) -> Column:
    """Levels of the intervals of ``df`` as an array."""
    return small_list(df.where(F.col(start) <= F.col(end)).select(_level(start, end, seconds).alias("level")).distinct(), F.col("level"))


def by_cell(df: DataFrame, start: str, end: str, seconds: float = BUCKET_S, others: Column | None = None) -> DataFrame:
    """One copy of each interval per cell it touches on its own level and on the higher ones of ``others``: ``_own``, ``_level``, ``_cell``."""
    own = df.where(F.col(start) <= F.col(end)).withColumn("_own", _level(start, end, seconds))
    levels = F.array("_own") if others is None else F.array_union(F.array("_own"), others)
    listed = own.withColumn("_level", F.explode(levels)).where("_level >= _own")
    cells = F.sequence(_cell(start, F.col("_level"), seconds), _cell(end, F.col("_level"), seconds))
    return listed.withColumn("_cell", F.explode(cells))


def overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
    seconds: float = BUCKET_S,
) -> DataFrame:
    """Pairs of intervals with equal keys that overlap or touch. Column names must differ outside the keys."""
    (ls, le), (rs, re) = left_span, right_span
    a = by_cell(left, ls, le, seconds, levels_of(right, rs, re, seconds))
    b = by_cell(right, rs, re, seconds, levels_of(left, ls, le, seconds)).withColumnRenamed("_own", "_other")
    pairs = a.join(b, [*keys, "_level", "_cell"])
    once = (F.col("_level") == F.greatest("_own", "_other")) & (F.col("_cell") == _cell(F.greatest(ls, rs), F.col("_level"), seconds))
    return pairs.where(once & (F.col(rs) <= F.col(le)) & (F.col(re) >= F.col(ls))).drop("_level", "_cell", "_own", "_other")


def align_speech(
    episodes: DataFrame, transcript: DataFrame, min_ratio: float = 0.2, seconds: float = BUCKET_S
) -> DataFrame:
    """Pairs of episode and speech segment where more than ``min_ratio`` of the speech falls into the episode."""
    speech = transcript.where(F.col("end_s") > F.col("start_s"))
    pairs = overlapping(episodes, speech, ["session_id"], ("start_time", "end_time"), ("start_s", "end_s"), seconds)
    shared = F.least("end_s", "end_time") - F.greatest("start_s", "start_time")
    ratio = shared / (F.col("end_s") - F.col("start_s"))
    return pairs.withColumn("overlap_ratio", ratio).where(F.col("overlap_ratio") > min_ratio)


def aligned_speech(episodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Episodes with their aligned segments as an array in transcript order (empty if none)."""
    spoken = F.struct("seg_idx", "start_s", "end_s", "text")
    lists = pairs.groupBy(*KEYS, "start_frame").agg(F.sort_array(F.collect_list(spoken)).alias("_list"))
    plain = F.transform("_list", lambda s: F.struct(s["start_s"], s["end_s"], s["text"]))
    joined = episodes.join(lists, [*KEYS, "start_frame"], "left")
    return joined.withColumn("aligned_speech", F.coalesce(plain, F.array())).drop("_list")


def spoken_episodes(episodes: DataFrame, pairs: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` episodes of each session that have aligned speech, with it; ``lane`` numbers them from 0.

    They are in order of start, then hand. Only the speech of these episodes is collected.
    """
    episode = [*KEYS, "start_frame"]
    order = Window.partitionBy("session_id").orderBy("start_time", "hand", "start_frame")
    spoken = episodes.join(pairs.select(*episode).distinct(), episode, "left_semi")
    first = spoken.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
    first = first.withColumn("lane", F.col("_rank").cast("bigint") - 1).drop("_rank")
    return aligned_speech(first, pairs.join(first.select(*episode), episode, "left_semi"))


def first_covering(
    times: DataFrame, intervals: DataFrame, keys: Sequence[str], span: tuple[str, str], order: str,
    half_open: bool = False, seconds: float = BUCKET_S,
) -> DataFrame:
    """For each row of ``times`` (keys, time_s) the first interval by ``order`` that covers it, or NULLs.

    Bounds are inclusive; ``half_open`` excludes the end. Columns of the interval arrive as struct ``found``.
    """
    start, end = span
    # Repeated rows are looked up once and repeated at the end.
    points = times.groupBy(*times.columns).agg(F.count(F.lit(1)).alias("_n"))
    points = points.withColumn("_level", F.explode_outer(levels_of(intervals, start, end, seconds))).withColumn("_cell", _cell("time_s", F.col("_level"), seconds))
    spans = by_cell(intervals, start, end, seconds)
    payload = F.struct(*[c for c in intervals.columns if c not in keys]).alias("_hit")
    spans = spans.select(*keys, "_level", "_cell", F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(order).alias("_o"), payload)
    inside = (points["time_s"] >= spans["_s"]) & (
        (points["time_s"] < spans["_e"]) if half_open else (points["time_s"] <= spans["_e"])
    )
    same = [points[k] == spans[k] for k in keys] + [points["_level"] == spans["_level"], points["_cell"] == spans["_cell"], inside]
    joined = points.join(spans, same, "left").select(*[points[c] for c in times.columns], points["_n"], "_o", "_hit")
    found = joined.groupBy(*times.columns, "_n").agg(F.min_by("_hit", "_o").alias("found"))
    return found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).drop("_n")


def context_at(
    times: DataFrame, gestures: DataFrame, transcript: DataFrame, fps: float, seconds: float = BUCKET_S
) -> DataFrame:
    """Gesture of each hand ("None" if none) and the text spoken ("" if none) at given times.

    ``gestures`` holds session_id, hand, frame_idx, gesture with at most one row per hand and frame.
    """
    shown = gestures.groupBy("session_id", "frame_idx").agg(
        *[F.max(F.when(F.col("hand") == h, F.col("gesture"))).alias(f"gesture_{h}") for h in ("left", "right")]
    )
    asked = times.select("session_id", "time_s").distinct()
    said = first_covering(
        asked, transcript.select("session_id", "seg_idx", "start_s", "end_s", "text"), ["session_id"],
        ("start_s", "end_s"), "seg_idx", half_open=True, seconds=seconds,
    )
    framed = said.withColumn("frame_idx", (F.col("time_s") * fps).cast("bigint"))
    joined = framed.join(shown, ["session_id", "frame_idx"], "left")
    return joined.select(
        "session_id", "time_s",
        *[F.coalesce(f"gesture_{h}", F.lit("None")).alias(f"gesture_{h}") for h in ("left", "right")],
        F.coalesce("found.text", F.lit("")).alias("spoken"),
    )


def episode_at(times: DataFrame, episodes: DataFrame, seconds: float = BUCKET_S) -> DataFrame:
    """First episode of a hand covering a time (bounds inclusive). ``times``: session_id, hand, time_s."""
    return first_covering(times, episodes, KEYS, ("start_time", "end_time"), "start_frame", seconds=seconds)


def sentence_at(times: DataFrame, transcript: DataFrame, seconds: float = BUCKET_S) -> DataFrame:
    """First transcript segment covering a time (bounds inclusive). ``times``: session_id, time_s."""
    return first_covering(times, transcript, ["session_id"], ("start_s", "end_s"), "seg_idx", seconds=seconds)


def trail(requests: DataFrame, trace: DataFrame, n: int = 50) -> DataFrame:
    """The previous ``n`` frames' points whose successor is seen too, for each requested frame.

    ``requests``: session_id, hand, frame_idx. Requests are listed per wanted frame and meet the trace by
    equality, so a long trace spreads over its frames.
    """
    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        over = ordered(by, "frame_idx")
        return df.withColumns({f"next_{c}": F.lead(c).over(over) for c in "xy"})

    linked = in_chunks(trace.select(*KEYS, "frame_idx", "x", "y"), KEYS, "frame_idx", compute, 0, 1)
    linked = linked.where(F.col("x").isNotNull() & F.col("next_x").isNotNull())
    first = F.greatest(F.lit(0).cast("bigint"), F.col("frame_idx") - n)
    wanted = requests.where(F.col("frame_idx") > 0).select(
        *KEYS, F.col("frame_idx").alias("at_frame"), F.explode(F.sequence(first, F.col("frame_idx") - 1)).alias("frame_idx")
    )
    return wanted.join(linked, [*KEYS, "frame_idx"])
