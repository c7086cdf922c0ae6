"""Column expressions on arrays of landmarks (struct x, y, z, visibility)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Landmark numbers of a hand (21 points) and of a whole-body vector (133 points).
HAND_SOURCES = {
    "Whole Hand": range(0, 21),
    "Wrist": (0,),
    "Thumb": (1, 2, 3, 4),
    "Index": (5, 6, 7, 8),
    "Middle": (9, 10, 11, 12),
    "Ring": (13, 14, 15, 16),
    "Pinky": (17, 18, 19, 20),
    "Median": range(0, 21),
}
TIPS = {"Wrist": 0, "Thumb": 4, "Index": 8, "Middle": 12, "Ring": 16, "Pinky": 20}
PALM = (0, 5, 9, 13, 17)
NORMALIZED = {"Wrist": 0, "Thumb": 4, "Index": 8, "Median": 12}
BODY_SOURCES = {
    "Full Body": (tuple(range(0, 17)), 9, 10),
    "Arms": ((5, 7, 9, 6, 8, 10), 9, 10),
    "Legs": ((11, 13, 15, 12, 14, 16), 15, 16),
    "Head": ((0, 1, 2, 3, 4), 0, 0),
}
WHOLE_BODY_PARTS = {"body": (0, 17), "feet": (17, 6), "face": (23, 68), "left_hand": (91, 21), "right_hand": (112, 21)}
FINGERS = {"index": (8, 6, 5), "middle": (12, 10, 9), "ring": (16, 14, 13), "pinky": (20, 18, 17)}
MIN_VISIBILITY = 0.3


def at(landmarks: str | Column, i: int) -> Column:
    """Landmark ``i``, NULL if the array is shorter."""
    return F.get(landmarks if isinstance(landmarks, Column) else F.col(landmarks), F.lit(i))


def to_pixels(share: Column, size: int) -> Column:
    """Pixel coordinate, truncated towards zero."""
    return (share * float(size)).cast("int")


def pick(landmarks: str, indices) -> Column:
    """The landmarks with the given numbers, in that order."""
    if list(indices) == list(range(min(indices), max(indices) + 1)):
        return F.slice(landmarks, min(indices) + 1, len(indices))
    return F.array_compact(F.array(*[at(landmarks, i) for i in indices]))


def dist2(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def dist3(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "yz"), (a["x"] - b["x"]) * (a["x"] - b["x"])))


def _mean(landmarks: str, indices, axis: str) -> Column:
    points = [at(landmarks, i)[axis] for i in indices]
    return sum(points[1:], points[0]) / float(len(points))


def trace_share(landmarks: str, source: str) -> tuple[Column, Column]:
    """Tracked point of a hand in shares of the frame: a tip, the palm centre or the mean of all points."""
    if source in TIPS:
        tip = at(landmarks, TIPS[source])
        return tip["x"], tip["y"]
    indices = PALM if source == "Whole Hand" else range(21)
    return _mean(landmarks, indices, "x"), _mean(landmarks, indices, "y")


def depth_proxy(landmarks: str) -> Column:
    """Inverse wrist-to-middle-knuckle distance; a zero distance counts as 0.001."""
    scale = dist3(at(landmarks, 0), at(landmarks, 9))
    return 1.0 / F.when(scale == 0, 0.001).otherwise(scale)


def mean_visibility(landmarks: str) -> Column:
    total = F.aggregate(landmarks, F.lit(0.0), lambda s, p: s + F.coalesce(p["visibility"], F.lit(1.0)))
    return F.when(F.size(landmarks) > 0, total / F.size(landmarks))


def hand_visible(landmarks: str, threshold: float = MIN_VISIBILITY) -> Column:
    return F.coalesce(mean_visibility(landmarks) >= threshold, F.lit(False))


def finger_extended(landmarks: str, tip: int, pip: int, mcp: int) -> Column:
    """The tip is clearly farther from the wrist than the middle joint, and above the knuckle."""
    wrist, end = at(landmarks, 0), at(landmarks, tip)
    farther = dist2(end, wrist) > 1.1 * dist2(at(landmarks, pip), wrist)
    return farther & (end["y"] < at(landmarks, mcp)["y"])


def gesture_classify(landmarks: str) -> Column:
    """Rule-based gesture as struct<gesture, score>; NULL if no rule holds or points are missing."""
    index, middle, ring, pinky = (finger_extended(landmarks, *joints) for joints in FINGERS.values())
    count = sum((c.cast("int") for c in (middle, ring, pinky)), index.cast("int"))
    thumb, base = at(landmarks, 4)["y"], at(landmarks, 2)["y"]
    up, down = thumb < base - 0.05, thumb > base + 0.05
    result = lambda name, score: F.struct(F.lit(name).alias("gesture"), F.lit(score).alias("score"))
    rules = [
        ((count == 0) & ~up & ~down, "Closed_Fist", 0.85),
        (count == 4, "Open_Palm", 0.9),
        (index & (count == 1), "Pointing_Up", 0.85),
        (index & middle & (count == 2), "Victory", 0.85),
        (up & index & pinky & (count == 2), "ILoveYou", 0.8),
        (up & (count == 0), "Thumb_Up", 0.85),
        (down & (count == 0), "Thumb_Down", 0.85),
    ]
    chain = F.when(F.size(landmarks) < 21, None)
    for condition, name, score in rules:
        chain = chain.when(condition, result(name, score))
    return chain


def finger_count_pose(landmarks: str) -> Column:
    """Pose by the number of fingers whose tip is farther from the wrist (3-D) than an inner joint."""
    wrist = at(landmarks, 0)
    out = {t: dist3(at(landmarks, t), wrist) > dist3(at(landmarks, j), wrist) for t, j in ((4, 3), (8, 6), (12, 10), (16, 14), (20, 18))}
    count = sum((out[t].cast("int") for t in (8, 12, 16, 20)), out[4].cast("int"))
    return (
        F.when(count == 0, "Fist").when(count == 5, "Open")
        .when(count == 1, F.when(out[8], "Pointing").otherwise("1_Finger"))
        .when(count == 2, F.when(out[8] & out[12], "Peace").otherwise("2_Fingers"))
        .otherwise(F.concat(count.cast("string"), F.lit("_Fingers")))
    )


def normalized_point(landmarks: str, source: str = "Whole Hand") -> Column:
    """Point in shares of the frame used for densities; for "Median" the middle finger tip."""
    if source in NORMALIZED:
        point = at(landmarks, NORMALIZED[source])
        x, y = F.coalesce(point["x"], F.lit(0.0)), F.coalesce(point["y"], F.lit(0.0))
        return F.when(F.size(landmarks) > 0, F.struct(x.alias("x"), y.alias("y")))
    wrist, knuckle = at(landmarks, 0), at(landmarks, 9)
    centre = F.struct(((wrist["x"] + knuckle["x"]) / 2.0).alias("x"), ((wrist["y"] + knuckle["y"]) / 2.0).alias("y"))
    alone = F.struct(wrist["x"].alias("x"), wrist["y"].alias("y"))
    return F.when(F.size(landmarks) > 9, centre).when(F.size(landmarks) > 0, alone)


def rotate_point(x: Column, y: Column, angle: Column | int, width: int, height: int) -> Column:
    """Point of a frame shown rotated by 0, 90, 180 or 270 degrees, as struct<x, y>."""
    turn = F.lit(angle) if isinstance(angle, int) else angle
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return (
        F.when(turn == 90, point(height - y, x)).when(turn == 180, point(width - x, height - y))
        .when(turn == 270, point(y, width - x)).otherwise(point(x, y))
    )
