"""Motion episodes: segmentation, features, classification and summaries.

An episode row is (session_id, hand, start_frame, end_frame, start_time, end_time); ``start_frame`` identifies
it within its session and hand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from kinescribe.operators.traces import KEYS, POSITION, distance
from kinescribe.plans.chunks import CHUNK, CHUNK_ROWS, Part, chunk_of, dense_index, in_chunks, islands, ordered

EPISODE = [*KEYS, "start_frame"]

#: Quadratic fit over five points: weights for the middle, the first and the second point (each over 35).
MIDDLE, FIRST, SECOND = (-3, 12, 17, 12, -3), (31, 9, -3, -5, 3), (9, 13, 12, 6, -5)

#: Fixed values of the features and the classification.
DWELL_BELOW = 0.02
FIRST_SHARE, LAST_SHARE = 0.3, 0.8
REST_MEAN, REACH_START, DIRECT_ABOVE, EXPLORE_ABOVE = 0.03, 0.15, 0.7, 5
TYPES = ("rest", "reach", "direct_action", "exploratory", "manipulation")
KINEMATIC = (
    "mean_velocity", "max_velocity", "velocity_variance", "mean_acceleration", "acceleration_variance",
    "jerk_magnitude", "path_length", "path_efficiency", "spatial_spread_xy", "spatial_spread_z",
)
INTENT = (
    "initiation_velocity", "retraction_velocity", "reversal_count", "dwell_ratio", "hesitation_index", "effort_proxy",
)
EMBEDDED = (
    "mean_velocity", "max_velocity", "smoothness_sparc", "path_length", "path_efficiency", "jerk_magnitude",
    "initiation_velocity", "retraction_velocity", "reversal_count", "hesitation_index", "effort_proxy",
    "duration", "num_frames",
)


def _velocity(df: DataFrame, by: list[str]) -> DataFrame:
    over = ordered(by, POSITION)
    ahead = F.lead(F.struct("ts", "x", "y", "z")).over(over)
    df = df.withColumn("_next", ahead).where(F.col("_next").isNotNull())
    dt = F.col("_next.ts") - F.col("ts")
    speed = distance("xyz", [f"_next.{c}" for c in "xyz"]) / dt
    return df.withColumn("velocity", F.coalesce(F.when(dt > 0, speed), F.lit(0.0))).drop("_next")


def _weighted(weights: tuple[int, ...], offsets: range, cols: dict[int, Column]) -> Column:
    terms = [F.lit(float(w)) * cols[k] for w, k in zip(weights, offsets)]
    return sum(terms[1:], terms[0]) / 35.0


def _savgol(df: DataFrame, by: list[str]) -> DataFrame:
    over = ordered(by, POSITION)
    reads = {k: (F.lag("velocity", -k) if k < 0 else F.lead("velocity", k)).over(over) for k in range(-4, 5) if k}
    names = {k: f"_v{k + 4}" for k in reads}
    known = F.count("velocity").over(over.rowsBetween(-5, 5))
    df = df.withColumns({**{names[k]: reads[k] for k in reads}, "_known": known})
    at = {0: F.col("velocity"), **{k: F.col(n) for k, n in names.items()}}
    smooth = (
        F.when(F.col("_known") <= 5, at[0])
        .when(F.col(POSITION) == 0, _weighted(FIRST, range(0, 5), at))
        .when(F.col(POSITION) == 1, _weighted(SECOND, range(-1, 4), at))
        .when(at[1].isNull(), _weighted(FIRST[::-1], range(-4, 1), at))
        .when(at[2].isNull(), _weighted(SECOND[::-1], range(-3, 2), at))
        .otherwise(_weighted(MIDDLE, range(-2, 3), at))
    )
    return df.withColumn("smooth", smooth).drop("_known", *names.values())


def velocities(trace: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Speed from each frame to the next (0 where a point is missing), and its quadratic smoothing.

    The smoothing uses five points and applies to traces with more than five speeds.
    """
    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        return _savgol(_velocity(df, by), by)

    return in_chunks(trace, KEYS, POSITION, compute, 5, 6, rows)


def segment_episodes(
    trace: DataFrame, velocity_threshold: float = 0.05, min_duration: float = 0.3, smooth: bool = True,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Runs of frames faster than the threshold that last at least ``min_duration`` seconds."""
    speed = "smooth" if smooth else "velocity"

    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        df = _savgol(_velocity(df, by), by) if smooth else _velocity(df, by)
        idle_before = F.coalesce(F.lag(speed).over(ordered(by, POSITION)) <= velocity_threshold, F.lit(True))
        return df.withColumn("_opens", idle_before).where(F.col(speed) > velocity_threshold)

    active = in_chunks(trace, KEYS, POSITION, compute, 6, 6, rows)
    runs = islands(
        active, KEYS, POSITION, "_opens",
        {
            "start_frame": Part("min", F.col(POSITION)), "end_frame": Part("max", F.col(POSITION)),
            "start_time": Part("min", F.col("ts")), "end_time": Part("max", F.col("ts")),
        },
        rows,
    )
    return runs.where(F.col("end_time") - F.col("start_time") >= min_duration)


def merge_episodes(
    episodes: DataFrame, merge_gap: float = 0.2, bucket_s: float = 1800.0, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Join episodes of a hand that follow each other within ``merge_gap`` seconds, transitively.

    An episode is looked up from every time bucket in which a follower could start, so the gap to the
    previous episode is known inside each bucket.
    """
    bucket = lambda t: F.floor(t / bucket_s).cast("bigint")
    seen_from = F.sequence(bucket(F.col("start_time")), bucket(F.col("end_time") + merge_gap))
    copies = episodes.withColumn("_home", bucket(F.col("start_time"))).withColumn(CHUNK, F.explode(seen_from))
    before = F.lag("end_time").over(ordered([*KEYS, CHUNK], "start_frame"))
    opens = F.coalesce(F.col("start_time") - before > merge_gap, F.lit(True))
    flagged = copies.withColumn("_opens", opens).where(F.col("_home") == F.col(CHUNK)).drop(CHUNK, "_home")
    return islands(
        flagged.withColumn("_at", F.col("start_frame")), KEYS, "_at", "_opens",
        {
            "start_frame": Part("min", F.col("start_frame")), "end_frame": Part("max", F.col("end_frame")),
            "start_time": Part("min", F.col("start_time")), "end_time": Part("max", F.col("end_time")),
        },
        rows,
    )


def find_episodes(
    trace: DataFrame, velocity_threshold: float = 0.05, min_duration: float = 0.3, merge_gap: float = 0.2,
    smooth: bool = True, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Segmentation followed by merging."""
    return merge_episodes(segment_episodes(trace, velocity_threshold, min_duration, smooth, rows), merge_gap, rows=rows)


def episode_points(trace: DataFrame, episodes: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """The seen points of each episode.

    Each episode leaves a marker at its first frame in every chunk it covers; points take the last marker
    before them. Both inputs meet in one shuffle on (session, hand, chunk).
    """
    covered = F.sequence(chunk_of("start_frame", rows), chunk_of("end_frame", rows))
    markers = episodes.select(*KEYS, "start_frame", "end_frame", F.explode(covered).alias(CHUNK)).select(
        *KEYS, CHUNK, F.greatest("start_frame", F.col(CHUNK) * rows).alias(POSITION), F.lit(0).alias("_kind"),
        "start_frame", "end_frame",
    )
    seen = trace.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).select(
        *KEYS, chunk_of(POSITION, rows).alias(CHUNK), POSITION, F.lit(1).alias("_kind"), "ts", "x", "y", "z"
    )
    over = ordered([*KEYS, CHUNK], POSITION, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = markers.unionByName(seen, allowMissingColumns=True)
    both = both.withColumns({c: F.last(c, ignorenulls=True).over(over) for c in ("start_frame", "end_frame")})
    return both.where((F.col("_kind") == 1) & (F.col(POSITION) <= F.col("end_frame"))).drop("_kind", "end_frame")


def episode_motion(points: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Per point of an episode: rank ``r``, speed, acceleration, jerk and axis reversals towards the next points."""
    ranked = dense_index(points, EPISODE, F.col(CHUNK), [POSITION], "r", "points").drop(CHUNK)

    def compute(df: DataFrame, by: list[str]) -> DataFrame:
        over = ordered(by, "r")
        df = df.withColumn("_next", F.lead(F.struct("ts", "x", "y", "z")).over(over))
        dt = F.col("_next.ts") - F.col("ts")
        step = distance("xyz", [f"_next.{c}" for c in "xyz"])
        df = df.withColumns(
            {"dt": dt, "step": step, "velocity": F.when(dt > 0, step / dt)}
            | {f"_s{c}": F.signum(F.col(f"_next.{c}") - F.col(c)) for c in "xyz"}
        )
        df = df.withColumn("accel", (F.lead("velocity").over(over) - F.col("velocity")) / F.col("dt"))
        turns = [F.coalesce((F.lead(f"_s{c}").over(over) != F.col(f"_s{c}")).cast("int"), F.lit(0)) for c in "xyz"]
        df = df.withColumns(
            {"jerk": (F.lead("accel").over(over) - F.col("accel")) / F.col("dt"), "reversals": sum(turns[1:], turns[0])}
        )
        return df.drop("_next", "_sx", "_sy", "_sz")

    return in_chunks(ranked, EPISODE, "r", compute, 0, 3, rows)


def episode_features(episodes: DataFrame, motion: DataFrame) -> DataFrame:
    """Kinematic and intent features of every episode; zeros where fewer than two points were seen."""
    speeds = F.col("points") - 1
    moving = F.col("step").isNotNull()
    speed = F.when(moving, F.coalesce("velocity", F.lit(0.0)))
    early = F.col("r") < F.greatest(F.lit(1), (speeds * FIRST_SHARE).cast("int"))
    late = F.col("r") >= (speeds * LAST_SHARE).cast("int")
    point = F.struct("x", "y", "z")
    raw = motion.groupBy(*EPISODE).agg(
        F.avg("velocity").alias("mean_velocity"), F.max("velocity").alias("max_velocity"),
        F.var_pop("velocity").alias("velocity_variance"),
        F.avg(F.abs("accel")).alias("mean_acceleration"), F.var_pop("accel").alias("acceleration_variance"),
        F.avg(F.abs("jerk")).alias("jerk_magnitude"),
        F.sum("step").alias("path_length"),
        F.min_by(point, "r").alias("_a"), F.max_by(point, "r").alias("_b"),
        F.sqrt((F.var_pop("x") + F.var_pop("y")) / 2.0 + F.pow(F.avg("x") - F.avg("y"), 2) / 4.0).alias("spatial_spread_xy"),
        F.stddev_pop("z").alias("spatial_spread_z"),
        F.max(F.when(early, speed)).alias("initiation_velocity"), F.avg(F.when(late, speed)).alias("retraction_velocity"),
        F.sum("reversals").cast("double").alias("reversal_count"),
        F.avg(F.when(moving, (speed < DWELL_BELOW).cast("double"))).alias("dwell_ratio"),
        F.sum(speed * speed * F.col("dt")).alias("effort_proxy"),
        F.first("points").alias("_points"),
    ).where(F.col("_points") >= 2)
    direct = distance([f"_a.{c}" for c in "xyz"], [f"_b.{c}" for c in "xyz"])
    raw = raw.withColumn("_direct", direct).withColumns(
        {
            "path_efficiency": F.when(F.col("_direct") > 0, F.col("_direct") / F.col("path_length")).otherwise(1.0),
            "hesitation_index": F.col("reversal_count") * 0.1 + F.col("dwell_ratio"),
        }
    )
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in (*KINEMATIC, *INTENT)}
    joined = episodes.join(raw.drop("_a", "_b", "_direct", "_points"), EPISODE, "left").withColumns(filled)
    return joined.withColumns(
        {
            "duration": F.col("end_time") - F.col("start_time"),
            "num_frames": F.col("end_frame") - F.col("start_frame") + 1,
            "episode_type": classify(),
            "confidence": confidence(),
        }
    )


def classify() -> Column:
    """Episode type from its features; the first rule that holds wins."""
    return (
        F.when(F.col("mean_velocity") < REST_MEAN, "rest")
        .when(F.col("initiation_velocity") > REACH_START, "reach")
        .when(F.col("path_efficiency") > DIRECT_ABOVE, "direct_action")
        .when(F.col("reversal_count") > EXPLORE_ABOVE, "exploratory")
        .otherwise("manipulation")
    )


def confidence() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 / (1.0 + F.col("hesitation_index"))))


SEGMENT = 256
HOP = SEGMENT // 2


def _power_spectrum(values: str) -> Column:
    """One-sided, mean-free, Hann-windowed power per frequency of each row's short array.

    The function is local so that it travels to the executors by value.
    """
    def spectrum(batch: pd.Series) -> pd.Series:
        out = np.empty(len(batch), dtype=object)
        sizes = batch.map(len).to_numpy()
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            block = np.stack(batch.iloc[rows].to_list()).astype(float)
            block -= block.mean(axis=1, keepdims=True)
            hann = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)
            power = np.abs(np.fft.rfft(block * hann, axis=1)) ** 2
            power[:, 1 : power.shape[1] - (1 if n % 2 == 0 else 0)] *= 2.0
            for i, row in zip(rows, power):
                out[i] = row
        return pd.Series(out)

    return F.pandas_udf(spectrum, ArrayType(DoubleType()))(values)


def sparc(motion: DataFrame) -> DataFrame:
    """Spectral arc length of each episode's speed profile (Welch spectrum); :func:`with_sparc` gives 0.0 below four speeds.

    The spectrum averages windows of at most 256 speeds that overlap by half, so no task ever holds more
    than one window of an episode.
    """
    # Places among the speeds there are: points without time between them have none.
    rows = dense_index(motion.where(F.col("velocity").isNotNull()), EPISODE, chunk_of("r"), ["r"], "k", "n").where(F.col("n") >= 4)
    block = F.floor(F.col("k") / HOP)
    windows = F.greatest(F.lit(1), F.floor((F.col("n") - HOP) / HOP)).cast("bigint")
    home = F.when(F.col("n") < SEGMENT, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(block - 1, block))
    spread = rows.withColumn("_windows", windows).withColumn("_w", F.explode(home))
    spread = spread.where((F.col("_w") >= 0) & (F.col("_w") < F.col("_windows")))
    series = spread.groupBy(*EPISODE, "_w").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "velocity"))), lambda s: s["velocity"]).alias("v")
    )
    power = series.select(*EPISODE, F.posexplode(_power_spectrum("v")).alias("k", "p"))
    mean = power.groupBy(*EPISODE, "k").agg(F.avg("p").alias("p"))
    spectrum = mean.groupBy(*EPISODE).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias("power")
    )
    clock = rows.groupBy(*EPISODE).agg(
        ((F.max("n") - 1) / (F.max("ts") - F.min("ts"))).alias("rate"), F.max("n").alias("n")
    )
    total = F.aggregate("power", F.lit(0.0), lambda a, p: a + p)
    width = F.col("rate") / F.least(F.col("n"), F.lit(SEGMENT))
    pairs = F.zip_with(
        F.slice("power", F.lit(2), F.size("power") - 1), F.slice("power", F.lit(1), F.size("power") - 1),
        lambda b, a: F.sqrt(width * width + F.pow((b - a) / F.col("total"), 2)),
    )
    arc = F.when(F.col("total") > 0, F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)).otherwise(0.0)
    joined = spectrum.join(clock, EPISODE).withColumn("total", total)
    return joined.select(*EPISODE, arc.alias("smoothness_sparc"))


def with_sparc(features: DataFrame, motion: DataFrame) -> DataFrame:
    joined = features.join(sparc(motion), EPISODE, "left")
    return joined.withColumn("smoothness_sparc", F.coalesce("smoothness_sparc", F.lit(0.0)))


def episode_embedding(features: DataFrame, dim: int = 32) -> DataFrame:
    """Unit-length feature vector, zero-padded (or cut) to ``dim``."""
    cells = [F.col(c).cast("float").cast("double") for c in EMBEDDED][:dim]
    raw = F.concat(F.array(*cells), F.array_repeat(F.lit(0.0), dim - len(cells)))
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda s, v: s + v * v))
    unit = F.transform("_raw", lambda v: F.when(F.col("_norm") > 0, v / F.col("_norm")).otherwise(v).cast("float"))
    return (
        features.withColumn("_raw", raw).withColumn("_norm", norm).withColumn("embedding", unit).drop("_raw", "_norm")
    )


def episode_metrics(features: DataFrame, sessions: DataFrame) -> DataFrame:
    """Count, mean duration, mean confidence and counts by type for both hands of every session."""
    hands = sessions.select("session_id").distinct().withColumn("hand", F.explode(F.array(F.lit("left"), F.lit("right"))))
    stats = features.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("count"), F.avg("duration").alias("avg_duration"), F.avg("confidence").alias("avg_confidence"),
        *[F.count_if(F.col("episode_type") == t).alias(t) for t in TYPES],
    )
    numbers = ["count", "avg_duration", "avg_confidence", *TYPES]
    filled = hands.join(stats, KEYS, "left").fillna(0, numbers)
    entries = F.filter(
        F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("n")) for t in TYPES]), lambda e: e["n"] > 0
    )
    return filled.withColumn("types", F.map_from_entries(entries))


def episode_type_totals(features: DataFrame) -> DataFrame:
    """Episodes by type: per session and hand (``totals`` 0), per session (1), and overall (3), in one pass."""
    rolled = features.groupBy("episode_type", "session_id", "hand").count()
    totals = F.grouping_id().cast("int")
    return rolled.rollup("episode_type", "session_id", "hand").agg(F.sum("count").alias("episodes"), totals.alias("totals")).where(
        F.col("totals") < 7
    )
