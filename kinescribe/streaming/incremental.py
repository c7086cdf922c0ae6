"""Incremental versions of three operators.

The functions take a streaming or a batch DataFrame and give the same rows for both. Without a ``watermark`` that holds
for rows in any order: the state keeps what was seen, and nothing is late. With one, the state is bounded and rows that
come later than it allows are dropped; event times must then follow the order of arrival, over all sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.operators.transcript import normalised
from kinescribe.plans.staging import fresh_folder

KEYS = ["session_id", "hand"]


def _bounded(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(time, watermark) if watermark else df


def gesture_tally(gestures: DataFrame, window: str = "60 seconds", watermark: str | None = None) -> DataFrame:
    """Observations per session, hand and gesture in tumbling windows of the event time ``ts``."""
    grouped = _bounded(gestures, "ts", watermark).groupBy(F.window("ts", window).alias("w"), *KEYS, "gesture")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *KEYS, "gesture", "n")


def presence_sessions(seen: DataFrame, gap: str = "200 milliseconds", watermark: str | None = None) -> DataFrame:
    """Stretches in which a hand was seen with pauses shorter than ``gap``; open ones as far as they go.

    To be run in complete mode without a watermark, in append mode (finished stretches only) with one.
    """
    grouped = _bounded(seen, "ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), *KEYS)
    return grouped.agg(F.count(F.lit(1)).alias("frames")).select(
        *KEYS, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames"
    )


def new_chunk_segments(segments: DataFrame, chunk_s: float = 300.0, overlap_s: float = 2.0, watermark: str | None = None) -> DataFrame:
    """Stream form of chunk stitching: segments on the session clock, repeats in the next chunk's overlap dropped.

    A repeated segment shows the same text around the same chunk border, so only border segments are kept in the state
    and deduplicated on (session, text, border). A ``watermark`` works on the column ``arrived``: when a chunk arrived,
    by the clock of the store and not by the place in its recording.
    """
    core = F.col("chunk_idx") * chunk_s
    offset = F.greatest(F.lit(0.0), core - overlap_s)
    timed = segments.withColumns({"start_s": F.col("start_s") + offset, "end_s": F.col("end_s") + offset})
    inside = timed.where((F.col("end_s") > core) & (F.col("start_s") < core + chunk_s))
    border = F.when(F.col("end_s") > core + chunk_s - overlap_s, F.col("chunk_idx") + 1).when(
        (F.col("start_s") < core + overlap_s) & (F.col("chunk_idx") > 0), F.col("chunk_idx")
    )
    placed = inside.withColumn("_border", border)
    keys = ["session_id", "_text", "_border"]
    edges = placed.where(F.col("_border").isNotNull()).withColumn("_text", normalised(F.col("text")))
    if watermark:
        edges = edges.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(keys)
    else:
        edges = edges.dropDuplicates(keys)
    return placed.where(F.col("_border").isNull()).drop("_border").unionByName(edges.drop("_border", "_text"))


def run_available(result: DataFrame, mode: str, keys: Sequence[str] = (), each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its rows as a table in the shared folder.

    In update mode the latest value per ``keys`` counts, in complete mode the last micro-batch. ``each`` may transform every
    micro-batch.
    """
    spark = result.sparkSession
    base = fresh_folder(spark, "streams")

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch) if each else batch
        mode_of_write = "overwrite" if mode == "complete" else "append"
        rows.withColumn("_batch", F.lit(batch_id)).write.mode(mode_of_write).parquet(f"{base}/rows")

    stream = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    stream.foreachBatch(append).start().awaitTermination()
    written = spark.read.parquet(f"{base}/rows")
    if mode != "update":
        return written.drop("_batch")
    values = [c for c in result.columns if c not in keys]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return latest.select(*keys, "v.*")
