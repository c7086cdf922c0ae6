"""Session tables derived from the driver tables, so that every operator runs over real rows.

Sessions of these tables are users, labels, conversations or sources; one of them may hold a large share of
the rows, so row numbers and running times are computed per bucket (see ``plans.chunks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinescribe.plans.chunks import dense_index, running_sum

WIDTH, HEIGHT = 640, 480
CHARS_PER_SECOND = 15.0
SECONDS_PER_SEGMENT = 5.0
#: Ids (or turns) per bucket when ranking by an id.
ID_BUCKET = 65_536


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _side(id_col: str) -> Column:
    return F.when(F.col(id_col) % 2 == 0, "left").otherwise("right")


def minute_of(ts: str) -> Column:
    """Minutes since 1970 on the timestamp's own clock, whatever the session's time zone."""
    return F.unix_date(F.to_date(ts)) * 1440 + F.hour(ts) * 60 + F.minute(ts)


def trace(spark: SparkSession, sf_dir: str, fps: float = 30.0) -> DataFrame:
    """pixel trace per user and hand; error events are frames without a detection."""
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        _side("event_id").alias("hand"),
        "ts",
        "event_id",
        (F.col("event_type") != "error").alias("seen"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    ranked = dense_index(events, ["session_id", "hand"], minute_of("ts"), ["ts", "event_id"], "frame_idx")
    return ranked.select(
        "session_id",
        "hand",
        "frame_idx",
        (F.col("frame_idx") / F.lit(float(fps))).alias("ts"),
        F.when(F.col("seen"), (F.col("value") * 1.3).cast("int").cast("double")).alias("x"),
        F.when(F.col("seen"), (F.col("k") * 4.8).cast("int").cast("double")).alias("y"),
        F.when(F.col("seen"), 1.0 + F.col("k") / 100.0).alias("z"),
    )


def slow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 at 0.1 frames a second, the clock on which it overlaps the transcript F3."""
    return trace(spark, sf_dir).withColumn("ts", F.col("frame_idx") * 10.0)


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with components mapped to about [0, 1]."""
    unit = F.transform("embedding", lambda e: (e.cast("double") + 1.0) / 2.0)
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("session_id"), "vec_id", unit.alias("q")
    )


def hand_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: 21 hand landmarks per vector, with the model's score."""
    ranked = dense_index(
        _scaled(spark, sf_dir).withColumn("hand", F.initcap(_side("vec_id"))),
        ["session_id", "hand"], F.floor(F.col("vec_id") / ID_BUCKET), ["vec_id"], "frame_idx",
    )
    point = lambda j: F.struct(
        F.col("q")[j * 3].alias("x"), F.col("q")[j * 3 + 1].alias("y"), F.col("q")[j * 3 + 2].alias("z"),
        F.lit(1.0).alias("visibility"),
    )
    return ranked.select(
        "session_id", "frame_idx", F.lit(0).alias("hand_no"), "hand", "vec_id",
        F.transform(F.sequence(F.lit(0), F.lit(20)), point).alias("landmarks"),
        F.col("q")[63].alias("score"),
    )


def body_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first 17 triples as body keypoints (x, y, visibility); one person per frame."""
    point = lambda j: F.struct(
        F.col("q")[j * 3].alias("x"), F.col("q")[j * 3 + 1].alias("y"), F.lit(0.0).alias("z"),
        F.col("q")[j * 3 + 2].alias("visibility"),
    )
    return _scaled(spark, sf_dir).select(
        "session_id", F.col("vec_id").alias("frame_idx"), F.lit(0).alias("person_no"), F.lit("body").alias("part"),
        F.transform(F.sequence(F.lit(0), F.lit(16)), point).alias("keypoints"),
    )


def pose_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """133 whole-body keypoints in pixels; four persons share a frame."""
    xy = lambda j: F.struct(
        (F.lit(float(WIDTH)) * F.element_at("q", (j * 2 % 63 + 1).cast("int"))).alias("x"),
        (F.lit(float(HEIGHT)) * F.element_at("q", ((j * 2 + 1) % 63 + 1).cast("int"))).alias("y"),
    )
    joints = F.sequence(F.lit(0), F.lit(132))
    return _scaled(spark, sf_dir).select(
        F.lit(0).cast("bigint").alias("session_id"),
        F.floor(F.col("vec_id") / 4).alias("frame_idx"),
        (F.col("vec_id") % 4).cast("int").alias("person_no"),
        F.col("q")[63].alias("bbox_score"),
        F.transform(joints, xy).alias("keypoints"),
        F.transform(joints, lambda j: F.element_at("q", (j % 64 + 1).cast("int"))).alias("scores"),
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation turns timed by text length."""
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seg_idx"), "text",
        F.length("text").cast("bigint").alias("chars"),
    )
    timed = running_sum(
        turns, ["session_id"], F.floor(F.col("seg_idx") / ID_BUCKET), ["seg_idx"], F.col("chars"), "before"
    )
    return timed.select(
        "session_id", "seg_idx",
        (F.col("before") / CHARS_PER_SECOND).alias("start_s"),
        (F.col("before") / CHARS_PER_SECOND + F.col("chars") / CHARS_PER_SECOND).alias("end_s"),
        "text",
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words with times by character offset, counting one separator per word."""
    segs = transcript(spark, sf_dir)
    split = segs.select("session_id", "seg_idx", "start_s", F.posexplode(F.split("text", r"\s+")).alias("word_no", "word"))
    # One segment is one text value, so its words always fit a task.
    before = Window.partitionBy("session_id", "seg_idx").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    return split.select(
        "session_id", "seg_idx", "word_no", "word",
        (F.col("start_s") + offset / CHARS_PER_SECOND).alias("start_s"),
        (F.col("start_s") + (offset + F.length("word")) / CHARS_PER_SECOND).alias("end_s"),
    )


def scored_segments(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """documents as segments of their source, with sentiment from the labels and a fixed topic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", *(["text"] if with_text else []))
    labels = read(spark, sf_dir, "labels")
    ranked = dense_index(
        docs.withColumnsRenamed({"source": "session_id", "doc_id": "seg_idx"}),
        ["session_id"], F.floor(F.col("seg_idx") / ID_BUCKET), ["seg_idx"], "n",
    )
    joined = ranked.join(labels, ranked["seg_idx"] == labels["doc_id"], "left")
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    score = F.when(F.col("doc_id").isNull(), None).when(F.col("toxic") == 1, -0.9).when(F.col("quality") == 1, 0.8)
    return joined.select(
        "session_id", "seg_idx",
        ((F.col("n") + 1) * SECONDS_PER_SEGMENT).alias("timestamp"),
        *(["text"] if with_text else []),
        sentiment.alias("sentiment"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(score, F.lit(0.0))).alias("sentiment_score"),
        topic_of("seg_idx").alias("topic"),
    )


def topic_of(id_col: str) -> Column:
    return F.when(F.col(id_col) % 11 == 0, -1).otherwise(F.col(id_col) % 7).cast("int")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors in double precision with their topic."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.transform("embedding", lambda e: e.cast("double")).alias("embedding"),
        F.col("label").alias("topic"),
    )


def gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one gesture observation per event."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), _side("event_id").alias("hand"),
        F.col("event_type").alias("gesture"), (F.col("value") / 500.0).alias("score"), "ts", "event_id",
    )
