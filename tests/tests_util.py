from __future__ import annotations

TRACE = "session_id string, hand string, frame_idx bigint, ts double, x double, y double, z double"


def trace_of(spark, xs, fps=30.0):
    """Left-hand trace moving along x; None is a frame without a detection."""
    rows = [("s", "left", i, i / fps, *((float(x), 0.0, 1.0) if x is not None else (None, None, None))) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, TRACE)
