"""Frame tables of landmarks to traces, gestures and per-person tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.functions import landmarks as lm


def sample_frames(frames: DataFrame, n: int = 10) -> DataFrame:
    """Every ``n``-th frame."""
    return frames.where(F.col("frame_idx") % n == 0)


def frame_spine(sessions: DataFrame) -> DataFrame:
    """One row per frame of each session (session_id, total_frames)."""
    block = 1_000_000
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total_frames") - 1) / block).cast("bigint"))
    blocks = sessions.where(F.col("total_frames") > 0).select("session_id", "total_frames", F.explode(starts).alias("_b"))
    last = F.least((F.col("_b") + 1) * block, F.col("total_frames")) - 1
    return blocks.select("session_id", F.explode(F.sequence(F.col("_b") * block, last)).alias("frame_idx"))


def with_missing_frames(sessions: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections on the full spine; frames without one have NULLs."""
    return frame_spine(sessions).join(detections, ["session_id", "frame_idx"], "left")


def trace_points(hand_frames: DataFrame, width: int, height: int, source: str = "Whole Hand") -> DataFrame:
    """Pixel point and depth proxy of every detected hand."""
    x, y = lm.trace_share("landmarks", source)
    return hand_frames.select(
        "session_id", "frame_idx", "hand_no", "hand",
        lm.to_pixels(x, width).cast("double").alias("x"), lm.to_pixels(y, height).cast("double").alias("y"),
        lm.depth_proxy("landmarks").alias("z"),
    )


def hand_pivot(points: DataFrame) -> DataFrame:
    """One point per frame and side: "Left" is left, any other label right; the last hand of a frame wins."""
    side = F.when(F.col("hand") == "Left", "left").otherwise("right")
    chosen = points.groupBy("session_id", "frame_idx", side.alias("hand")).agg(
        F.max_by(F.struct("x", "y", "z"), "hand_no").alias("p")
    )
    return chosen.select("session_id", "hand", "frame_idx", "p.x", "p.y", "p.z")


def build_trace(sessions: DataFrame, points: DataFrame) -> DataFrame:
    """Trace table: both hands on the frame spine, NULL where not detected. ``sessions`` carries fps."""
    spine = frame_spine(sessions).withColumn("hand", F.explode(F.array(F.lit("left"), F.lit("right"))))
    fps = sessions.select("session_id", F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("_fps"))
    joined = spine.join(points, ["session_id", "hand", "frame_idx"], "left").join(fps, "session_id")
    return joined.select(
        "session_id", "hand", "frame_idx", (F.col("frame_idx") / F.col("_fps")).alias("ts"), "x", "y", "z"
    )


def body_trace(body_frames: DataFrame, width: int, height: int, source: str = "Full Body") -> DataFrame:
    """Left and right trace points from body keypoints; too dimly seen points are NULL; depth is 1."""
    _, left, right = lm.BODY_SOURCES[source]
    sides = []
    for name, i in (("left", left), ("right", right)):
        p = lm.at("keypoints", i)
        seen = F.coalesce(p["visibility"], F.lit(1.0)) >= lm.MIN_VISIBILITY
        value = lambda c, size: F.when(seen, lm.to_pixels(p[c], size).cast("double"))  # noqa: B023, E731
        sides.append(
            F.struct(
                F.lit(name).alias("hand"), value("x", width).alias("x"), value("y", height).alias("y"),
                F.when(seen & p.isNotNull(), F.lit(1.0)).alias("z"),
            )
        )
    return body_frames.select("session_id", "frame_idx", F.explode(F.array(*sides)).alias("p")).select(
        "session_id", "frame_idx", "p.*"
    )


def boxes_of(points: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel bounding box of each row's ``points``, clamped to the frame; empty sides become one pixel wide.

    Boxes that lie off the frame are left out. The steps are separate projections so that the coordinate
    arrays are built once.
    """
    pixels = points.select(
        "session_id",
        F.transform("points", lambda p: lm.to_pixels(p["x"], width)).alias("xs"),
        F.transform("points", lambda p: lm.to_pixels(p["y"], height)).alias("ys"),
    )
    ends = pixels.select(
        "session_id", F.array_min("xs").alias("lx"), F.array_max("xs").alias("hx"),
        F.array_min("ys").alias("ly"), F.array_max("ys").alias("hy"),
    ).where(F.col("lx").isNotNull())
    clamped = ends.select(
        "session_id", F.greatest(F.lit(0), "lx").alias("x0"), F.least(F.lit(width), "hx").alias("x1"),
        F.greatest(F.lit(0), "ly").alias("y0"), F.least(F.lit(height), "hy").alias("y1"),
    ).where((F.col("x0") < width) & (F.col("y0") < height))
    widened = [F.when(F.col(f"{c}1") == F.col(f"{c}0"), F.col(f"{c}0") + 1).otherwise(F.col(f"{c}1")).alias(f"{c}1") for c in "xy"]
    return clamped.select("session_id", "x0", widened[0], "y0", widened[1]).where(
        (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    )


def hand_boxes(hand_frames: DataFrame, width: int, height: int, source: str = "Whole Hand") -> DataFrame:
    """Clamped bounding box of the source's landmarks per detected hand."""
    return boxes_of(
        hand_frames.select("session_id", lm.pick("landmarks", lm.HAND_SOURCES[source]).alias("points")), width, height
    )


def body_boxes(body_frames: DataFrame, width: int, height: int, source: str = "Full Body") -> DataFrame:
    """Clamped bounding box of the visible keypoints of a body region."""
    region = lm.pick("keypoints", lm.BODY_SOURCES[source][0])
    visible = F.filter(region, lambda p: F.coalesce(p["visibility"], F.lit(1.0)) >= lm.MIN_VISIBILITY)
    return boxes_of(body_frames.select("session_id", visible.alias("points")), width, height)


def wholebody_split(pose_raw: DataFrame, width: int, height: int) -> DataFrame:
    """One row per person and body part, with keypoints in shares of the frame and score as visibility."""
    def part(name: str, first: int, count: int):
        points = F.zip_with(
            F.slice("keypoints", first + 1, count), F.slice("scores", first + 1, count),
            lambda p, s: F.struct(
                (p["x"] / width).alias("x"), (p["y"] / height).alias("y"), F.lit(0.0).alias("z"), s.alias("visibility")
            ),
        )
        return F.struct(F.lit(name).alias("part"), points.alias("keypoints"))

    parts = F.array(*[part(n, *span) for n, span in lm.WHOLE_BODY_PARTS.items()])
    return pose_raw.select("session_id", "frame_idx", "person_no", F.explode(parts).alias("p")).select(
        "session_id", "frame_idx", "person_no", "p.*"
    )


def top_person(pose_raw: DataFrame) -> DataFrame:
    """The person with the highest box score in each frame (missing counts 0; ties: the first person)."""
    rank = F.struct(F.coalesce("bbox_score", F.lit(0.0)), -F.col("person_no"))
    others = [c for c in pose_raw.columns if c not in ("session_id", "frame_idx")]
    best = pose_raw.groupBy("session_id", "frame_idx").agg(F.max_by(F.struct(*others), rank).alias("b"))
    return best.select("session_id", "frame_idx", "b.*")


def gesture_rows(hand_frames: DataFrame) -> DataFrame:
    """Rule-based gesture per detected hand (NULL if none applies)."""
    return hand_frames.withColumn("g", lm.gesture_classify("landmarks")).select(
        "session_id", "frame_idx", "hand", F.col("g.gesture").alias("gesture"), F.col("g.score").alias("score")
    )


def gesture_counts(gestures: DataFrame) -> DataFrame:
    """Observations per session, hand and label; the label "None" counts like any other."""
    return gestures.where(F.col("gesture").isNotNull()).groupBy("session_id", "hand", "gesture").count()


def gesture_matrix(gestures: DataFrame, labels: Sequence[str], hands: Sequence[str] = ("left", "right")) -> DataFrame:
    """Sessions by hand and gesture label, 0 where none: one column per given hand and label.

    One aggregation; the labels are given, so no pass over the data is needed to find the columns.
    """
    cells = [
        F.count_if((F.col("hand") == h) & (F.col("gesture") == g)).alias(f"{h.capitalize()}_{g}") for h in hands for g in labels
    ]
    return gestures.where(F.col("gesture").isNotNull()).groupBy("session_id").agg(*cells)


def gesture_labels(gestures: DataFrame) -> DataFrame:
    """Distinct gesture labels, sorted."""
    return gestures.select("gesture").where(F.col("gesture").isNotNull()).distinct().orderBy("gesture")
