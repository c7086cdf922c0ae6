"""Cleaning of motion traces, speed, phases and their summaries.

Every function takes a ``trace`` table (session_id, hand, frame_idx, ts, x, y, z; one row per frame, x/y/z
NULL where the hand was not seen) and is exact for any ``rows`` (chunk length), see ``plans.chunks``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescribe.plans.chunks import CHUNK, CHUNK_ROWS, Part, chunk_of, dense_index, in_chunks, islands, ordered, with_totals

KEYS = ["session_id", "hand"]
POSITION = "frame_idx"

#: Phase codes.
MISSING, REST, REACH, HOVER = -1, 0, 1, 2
#: Shares of the top speed below which a point rests and above which it reaches.
REST_BELOW, REACH_ABOVE = 0.1, 0.4
#: Displacements (pixels) up to this are no reach.
SMALL_REACH = 10.0


def distance(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """Euclidean distance of two points given by their coordinates."""
    pairs = [(F.col(p) if isinstance(p, str) else p, F.col(q) if isinstance(q, str) else q) for p, q in zip(a, b)]
    squares = [(p - q) * (p - q) for p, q in pairs]
    return F.sqrt(sum(squares[1:], squares[0]))


def _xy() -> list[str]:
    return ["x", "y"]


def _drop_short(df: DataFrame, by: list[str], min_len: int, max_jump: float) -> DataFrame:
    over = ordered(by, POSITION)
    jump = distance(_xy(), [F.lag(c).over(over) for c in _xy()])
    opens = F.col("x").isNull() | F.lag("x").over(over).isNull() | (jump > max_jump)
    flagged = df.withColumn("_seg", opens.cast("int"))
    flagged = flagged.withColumn("_seg", F.sum("_seg").over(over))
    size = F.count("x").over(ordered([*by, "_seg"], POSITION).rowsBetween(-min_len, min_len))
    sized = flagged.withColumn("_keep", size >= min_len)
    return sized.withColumns({c: F.when(F.col("_keep"), F.col(c)) for c in ("x", "y", "z")}).drop("_seg", "_keep")


def filter_trace(
    trace: DataFrame, width: int, height: int, min_len: int = 5, max_jump_pct: float = 0.10, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Set points to NULL that belong to segments shorter than ``min_len``.

    A segment ends where the hand is missing or jumps by more than ``max_jump_pct`` of the diagonal. Whether
    a segment is long enough shows within ``min_len`` rows, so no full segment length is needed.
    """
    limit = max_jump_pct * math.hypot(width, height)
    return in_chunks(
        trace, KEYS, POSITION, lambda df, by: _drop_short(df, by, min_len, limit), min_len + 1, min_len + 1, rows
    )


def _steps(df: DataFrame, by: list[str]) -> DataFrame:
    over = ordered(by, POSITION)
    step = F.coalesce(distance(_xy(), [F.lag(c).over(over) for c in _xy()]), F.lit(0.0))
    return df.withColumn("step", step).where(F.col(POSITION) > 0)


def step_distance(trace: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """2-D distance to the previous frame; 0 where either point is missing; no row for the first frame."""
    return in_chunks(trace, KEYS, POSITION, _steps, 1, 0, rows)


def _median_of(values: list[Column]) -> Column:
    known = F.array_sort(F.array_compact(F.array(*values)))
    n = F.size(known)
    return (F.element_at(known, ((n + 1) / 2).cast("int")) + F.element_at(known, (n / 2 + 1).cast("int"))) / 2.0


def _smooth(df: DataFrame, by: list[str], column: str, window: int, out: str) -> DataFrame:
    over = ordered(by, POSITION)
    reach = window // 2
    around = [F.lag(column, k).over(over) for k in range(reach, 0, -1)]
    around += [F.col(column)] + [F.lead(column, k).over(over) for k in range(1, reach + 1)]
    names = [f"_n{i}" for i in range(len(around))]
    return df.withColumns(dict(zip(names, around))).withColumn(out, _median_of([F.col(n) for n in names])).drop(*names)


def median_smooth(df: DataFrame, column: str, window: int = 5, out: str = "smooth", rows: int = CHUNK_ROWS) -> DataFrame:
    """Centred rolling median of a non-NULL column, shrinking at both ends of the trace."""
    reach = window // 2
    return in_chunks(df, KEYS, POSITION, lambda d, by: _smooth(d, by, column, window, out), reach, reach, rows)


def speeds(
    trace: DataFrame, width: int, height: int, min_len: int = 5, max_jump_pct: float = 0.10, window: int = 5,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Filter, step distance and rolling median in one pass: raw ``step`` and ``speed`` per frame."""
    limit = max_jump_pct * math.hypot(width, height)

    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        return _smooth(_steps(_drop_short(df, by, min_len, limit), by), by, "step", window, "speed")

    reach = min_len + 2 + window // 2
    return in_chunks(trace, KEYS, POSITION, compute, reach, reach, rows)


def motion_metrics(speed_rows: DataFrame) -> DataFrame:
    """Total raw distance, and maximum and mean smoothed speed, per session and hand."""
    return speed_rows.groupBy(*KEYS).agg(
        F.sum("step").alias("total_distance"), F.max("speed").alias("max_speed"), F.avg("speed").alias("avg_speed")
    )


def derivatives(trace: DataFrame, fps: float, rows: int = CHUNK_ROWS) -> DataFrame:
    """Speed, acceleration and jerk over the seen points only, with a constant time step of 1/fps.

    ``n`` numbers the seen points from 0. The first 1/2/3 values of speed/acceleration/jerk are 0. Also
    returned: the 3-D ``step``, the neighbouring speeds and the neighbouring points, for the phase operators.
    Traces with fewer than five seen points are left out. Chunk numbers over ``n`` are kept for reuse.
    """
    dt = 1.0 / fps
    seen = trace.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    numbered = dense_index(seen, KEYS, chunk_of(POSITION, rows), [POSITION], "n", "points").where(F.col("points") >= 5)

    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        over = ordered(by, "n")
        here = F.struct("x", "y", "z")
        df = df.withColumns({"before": F.lag(here).over(over), "after": F.lead(here).over(over)})
        df = df.withColumn("step", distance("xyz", ["before.x", "before.y", "before.z"]))
        df = df.withColumn("speed", F.coalesce(F.col("step") / dt, F.lit(0.0)))
        df = df.withColumns({"prev_speed": F.lag("speed").over(over), "next_speed": F.lead("speed").over(over)})
        accel = F.when(F.col("n") < 2, 0.0).otherwise((F.col("speed") - F.col("prev_speed")) / dt)
        df = df.withColumn("accel", accel)
        jerk = F.when(F.col("n") < 3, 0.0).otherwise(F.abs((F.col("accel") - F.lag("accel").over(over)) / dt))
        return df.withColumn("jerk", jerk)

    return in_chunks(numbered, KEYS, "n", compute, 3, 1, rows, keep_chunk=True)


def _phase(speed: Column, top: Column) -> Column:
    return F.when(speed < top * REST_BELOW, REST).when(speed > top * REACH_ABOVE, REACH).otherwise(HOVER)


def phases(derived: DataFrame) -> DataFrame:
    """Rest / reach / hover for each row of :func:`derivatives`, relative to the trace's top speed."""
    topped = with_totals(
        derived, KEYS, CHUNK, {"_top": F.max("speed")}, lambda _e, _u, whole: {"top_speed": F.max("_top").over(whole)}
    )
    label = lambda c: _phase(F.col(c), F.col("top_speed"))
    return topped.withColumns(
        {
            "phase": label("speed"),
            "prev_phase": F.when(F.col("prev_speed").isNotNull(), label("prev_speed")),
            "next_phase": F.when(F.col("next_speed").isNotNull(), label("next_speed")),
        }
    ).drop("top_speed")


def phase_label(trace: DataFrame, phased: DataFrame) -> DataFrame:
    """Phase of every frame of the trace; -1 where the point is missing or the trace too short."""
    labels = phased.select(*KEYS, POSITION, "phase")
    spine = trace.select(*KEYS, POSITION)
    return spine.join(labels, [*KEYS, POSITION], "left").withColumn("phase", F.coalesce("phase", F.lit(MISSING)))


def reach_runs(phased: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Each finished reach with its path length and the displacement between the points around it."""
    reach = phased.where(F.col("phase") == REACH).withColumn(
        "_opens", F.coalesce(F.col("prev_phase") != REACH, F.lit(True))
    )
    runs = islands(
        reach, KEYS, "n", "_opens",
        {
            "first_n": Part("min", F.col("n")),
            "path": Part("sum", F.col("step")),
            "start": Part("first", F.col("before")),
            "stop": Part("last", F.col("after")),
        },
        rows,
    )
    moved = distance([f"start.{c}" for c in "xyz"], [f"stop.{c}" for c in "xyz"])
    return runs.where(F.col("stop").isNotNull()).select(*KEYS, "first_n", "path", moved.alias("displacement"))


def reach_tortuosity(phased: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean path / displacement of the finished reaches that moved; NULL-free only for traces with one."""
    kept = reach_runs(phased, rows).where(F.col("displacement") > SMALL_REACH)
    return kept.groupBy(*KEYS).agg(F.avg(F.col("path") / F.col("displacement")).alias("tortuosity"))


def hmi_metrics(phased: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Phase counts, hover points, tortuosity (default 1.0) and mean jerk per session and hand."""
    count = lambda code: F.count_if(F.col("phase") == code)
    base = phased.groupBy(*KEYS).agg(
        count(REST).alias("rest"), count(REACH).alias("reach"), count(HOVER).alias("hover"),
        F.avg("jerk").alias("avg_jerk"),
    )
    joined = base.join(reach_tortuosity(phased, rows), KEYS, "left")
    return joined.withColumn("tortuosity", F.coalesce("tortuosity", F.lit(1.0)))


def hover_hotspots(phased: DataFrame) -> DataFrame:
    """The points at which the hand hovered."""
    return phased.where(F.col("phase") == HOVER).select(*KEYS, POSITION, "x", "y", "z")


def phase_runs(labelled: DataFrame, fps: float, rows: int = CHUNK_ROWS) -> DataFrame:
    """Runs of equal phase over all frames: start and duration in seconds."""
    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn(
            "_opens", F.coalesce(F.lag("phase").over(ordered(by, POSITION)) != F.col("phase"), F.lit(True))
        )

    flagged = in_chunks(labelled, KEYS, POSITION, compute, 1, 0, rows)
    return _timed_runs(flagged, {"phase": Part("first", F.col("phase"))}, fps, rows)


def presence_runs(trace: DataFrame, fps: float, rows: int = CHUNK_ROWS) -> DataFrame:
    """Runs of frames in which the hand was seen: start and duration in seconds."""
    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn("_opens", F.lag("x").over(ordered(by, POSITION)).isNull())

    flagged = in_chunks(trace, KEYS, POSITION, compute, 1, 0, rows).where(F.col("x").isNotNull())
    return _timed_runs(flagged, {}, fps, rows)


def _timed_runs(flagged: DataFrame, extra: dict[str, Part], fps: float, rows: int) -> DataFrame:
    runs = islands(
        flagged, KEYS, POSITION, "_opens",
        {**extra, "start_frame": Part("min", F.col(POSITION)), "frames": Part("sum", F.lit(1))}, rows,
    )
    return runs.select(
        *KEYS, *extra, (F.col("start_frame") / fps).alias("start_s"), (F.col("frames") / fps).alias("duration_s")
    )


def frame_chunks(trace: DataFrame, fps: float, seconds: int = 60) -> DataFrame:
    """Reporting chunk of each frame (``seconds`` long)."""
    per_chunk = int(seconds * fps)
    return trace.withColumn("chunk_idx", F.floor(F.col(POSITION) / per_chunk).cast("bigint"))


def chunk_count(duration_s: Column, seconds: int = 60) -> Column:
    """Number of reporting chunks of a recording."""
    return (duration_s / seconds).cast("int") + 1


def performance_comparison(metrics: DataFrame, hmi: DataFrame) -> DataFrame:
    """One row per session: left/right speed, tortuosity and jerk, a missing hand counting as 0.

    ``mean_tortuosity`` averages the hands that have one; ``is_best`` marks the lowest (ties: all), leaving
    out sessions without any.
    """
    both = metrics.join(hmi.select(*KEYS, "tortuosity", "avg_jerk"), KEYS, "left")
    pick = lambda c, hand: F.max(F.when(F.col("hand") == hand, F.col(c)))
    columns = [
        F.coalesce(pick(source, hand), F.lit(0.0)).alias(f"{name}_{hand}")
        for source, name in (("avg_speed", "speed"), ("tortuosity", "tortuosity"), ("avg_jerk", "jerk"))
        for hand in ("left", "right")
    ]
    wide = both.groupBy("session_id").agg(*columns, F.avg("tortuosity").alias("mean_tortuosity"))
    best = wide.agg(F.min("mean_tortuosity")).scalar()
    return wide.withColumn("is_best", F.coalesce(F.col("mean_tortuosity") == best, F.lit(False)))
