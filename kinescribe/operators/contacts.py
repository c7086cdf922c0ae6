"""Contact events between body parts and objects, from a table of distances per frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.plans.chunks import CHUNK, CHUNK_ROWS, Part, in_chunks, islands, ordered, with_totals

KEYS = ["session_id", "person_id", "body_part", "object_id"]


def contact_events(
    distances: DataFrame, touch: float, release: float, frames: int, fps: float, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Contacts open after ``frames`` consecutive frames closer than ``touch`` and close after as many farther
    than ``release``; in between the state holds.

    ``distances``: KEYS, object_label, frame_idx (dense), distance_px. The state before a chunk is the last
    signal of any earlier chunk, so chunks are evaluated in parallel.
    """
    def signals(df: DataFrame, by: list[str]) -> DataFrame:
        recent = ordered(by, "frame_idx").rowsBetween(-(frames - 1), 0)
        all_recent = lambda c: (F.count_if(c).over(recent) == frames)
        signal = F.when(all_recent(F.col("distance_px") < touch), 1).when(all_recent(F.col("distance_px") > release), 0)
        return df.withColumn("signal", signal)

    marked = in_chunks(distances, KEYS, "frame_idx", signals, frames - 1, 0, rows, keep_chunk=True)
    last = F.max_by("signal", F.when(F.col("signal").isNotNull(), F.col("frame_idx")))
    carried = with_totals(
        marked, KEYS, CHUNK, {"_last": last}, lambda earlier, _u, _w: {"_carry": F.last("_last", ignorenulls=True).over(earlier)}
    )
    here = ordered([*KEYS, CHUNK], "frame_idx")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    state = lambda w: F.coalesce(F.last("signal", ignorenulls=True).over(w), F.col("_carry"), F.lit(0))
    opened = carried.withColumns({"_state": state(upto), "_was": state(before)}).where(F.col("_state") == 1)
    events = islands(
        opened.withColumn("_opens", F.col("_was") == 0).drop(CHUNK), KEYS, "frame_idx", "_opens",
        {
            "start_frame": Part("min", F.col("frame_idx")), "end_frame": Part("max", F.col("frame_idx")),
            "total": Part("sum", F.col("distance_px")), "frames": Part("sum", F.lit(1)),
            "object_label": Part("first", F.col("object_label")),
        },
        rows,
    )
    return events.select(
        *KEYS, "object_label", (F.col("start_frame") / fps).alias("t_start"), (F.col("end_frame") / fps).alias("t_end"),
        (F.col("total") / F.col("frames")).alias("mean_distance_px"), "frames",
    )
