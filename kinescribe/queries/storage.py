"""Round trips through the session store, and the streaming operators run over the event table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe import fixtures
from kinescribe.plans.chunks import CHUNK_ROWS
from kinescribe.plans.staging import fresh_folder, stage
from kinescribe.queries.base import query, r, sr, with_
from kinescribe.sources import library, sessions
from kinescribe.streaming import incremental


@query("session_roundtrip", f"""WITH f AS (SELECT 'user ' || user_id AS session_id, 640 AS width, event_id AS frame_idx, {sr('value', 'x')} FROM events)
       SELECT session_id, width, frame_idx, x, CAST(NULL AS BIGINT) AS seg_idx, CAST(NULL AS VARCHAR) AS text FROM f
       UNION ALL SELECT 'user ' || (conv_id % 100), CAST(NULL AS INT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), conv_id * 1048576 + turn, text FROM conversations
       WHERE conv_id % 100 <> 7
       UNION ALL SELECT 'user 7', CAST(NULL AS INT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 1, 'second save'""")
def session_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Save one session per user (trace and transcript), save one of them again, and read all rows back."""
    root = fresh_folder(spark, "library")
    events = fixtures.read(spark, sf, "events").withColumn("session_id", F.concat(F.lit("user "), "user_id"))
    trace = events.select("session_id", F.lit("left").alias("hand"), F.col("event_id").alias("frame_idx"), F.col("value").alias("x"))
    speech = fixtures.read(spark, sf, "conversations").select(
        F.concat(F.lit("user "), F.col("conv_id") % 100).alias("session_id"), (F.col("conv_id") * 1048576 + F.col("turn")).alias("seg_idx"), "text"
    )
    sessions.write_session({"sessions": events.select("session_id").distinct(), "trace": trace, "transcript": speech}, root)
    again = spark.range(1).select(F.lit("user 7").alias("session_id"), F.lit(1).cast("bigint").alias("seg_idx"), F.lit("second save").alias("text"))
    sessions.write_session({"transcript": again}, root)
    saved = sessions.read_sessions(spark, root)
    frames = saved["trace"].join(saved["sessions"].select("session_id", "width"), "session_id").select("session_id", "width", "frame_idx", r("x"))
    return frames.unionByName(saved["transcript"].select("session_id", "seg_idx", "text"), allowMissingColumns=True)


@query("schema_upgrade", """SELECT user_id AS session_id, event_id AS frame_idx, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS person_no FROM events""")
def schema_upgrade(spark: SparkSession, sf: str) -> DataFrame:
    """Every third frame has a person list; the others come from the older single-person table."""
    events = fixtures.read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_idx"), F.lit("nose").alias("part"), F.col("value").alias("x"))
    persons = events.where("frame_idx % 3 = 0").withColumn("person_no", F.lit(2))
    return sessions.upgrade_bodies(persons, events).select("session_id", "frame_idx", "person_no")


@query("hands_upgrade", """SELECT user_id AS session_id, BOOL_OR(event_type <> 'error') AS has_hands FROM events GROUP BY 1""")
def hands_upgrade(spark: SparkSession, sf: str) -> DataFrame:
    events = fixtures.read(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_type", F.col("event_id").alias("frame_idx"))
    known = events.select("session_id").distinct().withColumn("has_hands", F.lit(None).cast("boolean"))
    return sessions.upgrade_has_hands(known, events.where("event_type <> 'error'")).select("session_id", "has_hands")


@query("union_sessions", """SELECT user_id AS session_id, event_id AS frame_idx, CASE WHEN event_id % 2 = 0 THEN 'left' END AS hand FROM events""")
def union_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """An older source without hands and a newer one, under one schema."""
    events = fixtures.read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_idx"))
    return sessions.union_sessions(events.where("frame_idx % 2 = 0").withColumn("hand", F.lit("left")), events.where("frame_idx % 2 <> 0"))


#: The texts are invented, so the probe lexicon lists their most common short words.
PROBE_LEXICON = {"English": ["the", "and", "with"], "French": ["le", "une", "avec"], "German": ["der", "und", "mit"]}
_LEXICON = ", ".join(f"('{c}', '{t}')" for c, terms in PROBE_LEXICON.items() for t in terms)


@query("lexicon_mentions", with_([f"lx AS (SELECT * FROM (VALUES {_LEXICON}) l(category, term))",
       "w AS (SELECT DISTINCT doc_id, UNNEST(STRING_SPLIT_REGEX(LOWER(text), '[^\\p{L}]+')) AS term FROM documents)"],
       "SELECT category, term, COUNT(*) AS documents FROM w JOIN lx USING (term) GROUP BY ALL"))
def lexicon_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents mentioning each term of a lexicon."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    mentioned = fixtures.read(spark, sf, "documents").select("doc_id", words.alias("term"))
    folder = f"{fresh_folder(spark, 'lexicon')}/json"
    spark.createDataFrame([(json.dumps(PROBE_LEXICON),)], "value string").write.text(folder)
    listed = library.lexicon_terms(library.read_lexicon(spark, folder))
    return mentioned.join(listed, "term").groupBy("category", "term").agg(F.count(F.lit(1)).alias("documents"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fixtures.read(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def as_gestures(events: DataFrame) -> DataFrame:
    hand = F.when(F.col("event_id") % 2 == 0, "left").otherwise("right")
    return events.select(
        F.col("user_id").alias("session_id"), hand.alias("hand"), F.col("event_type").alias("gesture"), F.col("ts").cast("timestamp").alias("ts")
    )


@query("gesture_tally_stream", """SELECT TIME_BUCKET(INTERVAL '6 hours', ts) AS window_start, user_id AS session_id,
       CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand, event_type AS gesture, COUNT(*) AS n FROM events GROUP BY ALL""")
def gesture_tally_stream(spark: SparkSession, sf: str) -> DataFrame:
    counted = incremental.gesture_tally(as_gestures(event_stream(spark, sf)), "6 hours")
    return incremental.run_available(counted, "update", ["window_start", "session_id", "hand", "gesture"])


@query("presence_sessions_stream", """WITH s AS (SELECT user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand, ts FROM events
       WHERE event_type <> 'error'), g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER p < INTERVAL '12 hours' THEN 0 ELSE 1 END AS o FROM s
       WINDOW p AS (PARTITION BY session_id, hand ORDER BY ts)),
       k AS (SELECT *, SUM(o) OVER (PARTITION BY session_id, hand ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
       SELECT session_id, hand, MIN(ts) AS start, MAX(ts) + INTERVAL '12 hours' AS "end", COUNT(*) AS frames FROM k GROUP BY session_id, hand, run""")
def presence_sessions_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions, open ones too, from four files that arrive one by one and in no time order."""
    folder = f"{fresh_folder(spark, 'events')}/rows"
    events = fixtures.read(spark, sf, "events").where(F.col("event_type") != "error")
    seen = as_gestures(events).withColumn("part", F.pmod(F.xxhash64("ts"), F.lit(4)))
    seen.repartition(4, "part").drop("part").write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return incremental.run_available(incremental.presence_sessions(stream, "12 hours"), "complete")


@query("stitched_segments_stream", "SELECT conv_id AS session_id, text, COUNT(*) AS n FROM conversations GROUP BY ALL")
def stitched_segments_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping 300-second chunks arriving as files; every segment must come out once."""
    from kinescribe.operators.lookups import overlapping
    from kinescribe.operators.transcript import chunk_bounds
    from kinescribe.queries.speech import sessions as timed_sessions

    bounds = chunk_bounds(timed_sessions(spark, sf))
    pairs = overlapping(bounds, fixtures.transcript(spark, sf), ["session_id"], ("extract_start", "extract_end"), ("start_s", "end_s"))
    cut = pairs.where((F.col("start_s") < F.col("extract_end")) & (F.col("end_s") > F.col("extract_start"))).select(
        "session_id", "chunk_idx", (F.greatest("start_s", "extract_start") - F.col("extract_start")).alias("start_s"),
        (F.least("end_s", "extract_end") - F.col("extract_start")).alias("end_s"), "text",
    )
    folder = f"{fresh_folder(spark, 'chunks')}/rows"
    cut.write.parquet(folder)
    stream = spark.readStream.schema(cut.schema).parquet(folder)
    out = incremental.run_available(incremental.new_chunk_segments(stream), "append")
    return out.groupBy("session_id", "text").agg(F.count(F.lit(1)).alias("n"))


CONTACTS_SQL = f"""WITH d AS (SELECT user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS body_part, value AS d,
       ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS f FROM events),
       s AS (SELECT *, CASE WHEN COUNT(*) FILTER (d < 15) OVER p = 2 THEN 1 WHEN COUNT(*) FILTER (d > 25) OVER p = 2 THEN 0 END AS signal FROM d
       WINDOW p AS (PARTITION BY session_id, body_part ORDER BY f ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
       t AS (SELECT *, COALESCE(LAST_VALUE(signal IGNORE NULLS) OVER (PARTITION BY session_id, body_part ORDER BY f
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM s),
       u AS (SELECT *, SUM(CASE WHEN state = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, body_part ORDER BY f) AS g FROM t)
       SELECT session_id, body_part, {sr('MIN(f) / 10.0', 't_start')}, {sr('MAX(f) / 10.0', 't_end')}, {sr('AVG(d)', 'mean_distance_px')}, COUNT(*) AS frames
       FROM u WHERE state = 1 GROUP BY session_id, body_part, g"""


def event_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as distances of the left or right hand to one object, numbered by time."""
    from kinescribe.operators import contacts
    from kinescribe.plans.chunks import dense_index

    events = fixtures.read(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.lit(0).alias("person_id"),
        F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("body_part"), F.lit(0).alias("object_id"),
        F.lit("cup").alias("object_label"), F.col("value").alias("distance_px"), "ts", "event_id",
    )
    return dense_index(events, contacts.KEYS, fixtures.minute_of("ts"), ["ts", "event_id"], "frame_idx")


@query("contact_events", CONTACTS_SQL)
def contact_events(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Event values as distances: touching below 15, released above 25, two frames each."""
    from kinescribe.operators import contacts

    out = contacts.contact_events(event_distances(spark, sf), 15.0, 25.0, 2, 10.0, rows)
    return out.select("session_id", "body_part", r("t_start"), r("t_end"), r("mean_distance_px"), "frames")


@query("contact_stream", CONTACTS_SQL)
def contact_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same from files that arrive one by one: frames up to 8 places out of order, then a heartbeat that closes open contacts."""
    from kinescribe.operators.contacts import KEYS
    from kinescribe.streaming import contacts

    placed = event_distances(spark, sf)
    # Frames are dealt by number, so a file holds a stretch of every session, and every third frame comes a file later.
    file = F.floor(F.col("frame_idx") / 5) + F.when(F.col("frame_idx") % 3 == 0, 1).otherwise(0)
    file = F.least(F.lit(3), F.floor(file / F.lit(4)))
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("file") * 60)
    sent = placed.withColumn("file", file).withColumn("arrived", arrived).select("session_id", "person_id", "body_part", "object_id", "object_label", "frame_idx", "distance_px", "arrived", "file")
    sent = stage(sent)
    beat = sent.limit(0).unionByName(spark.range(1).select(F.lit(4).alias("file"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("arrived")), allowMissingColumns=True)
    folder = f"{fresh_folder(spark, 'distances')}/rows"
    for part in range(4):
        # A key's stretch is in one file, so the order of its frames does not depend on how many files a batch takes.
        sent.where(F.col("file") == part).drop("file").repartition(8, *KEYS).write.mode("append").parquet(folder)
    beat.drop("file").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(sent.drop("file").schema).option("maxFilesPerTrigger", 8).parquet(folder)
    found, _ = contacts.run_contacts(contacts.contact_stream(stream, 15.0, 25.0, 2, delay=8), 10.0)
    return found.select(F.col("session_id").cast(placed.schema["session_id"].dataType).alias("session_id"), "body_part", r("t_start"), r("t_end"), r("mean_distance_px"), "frames")
