"""Episode segmentation, features and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe import fixtures
from kinescribe.operators import episodes as ep
from kinescribe.operators import lookups
from kinescribe.plans.chunks import CHUNK_ROWS
from kinescribe.plans.staging import stage
from kinescribe.queries.base import query, r, sr, trace_cte, with_

#: Parameters that are informative on the fixture: one frame every ten seconds, random positions.
PARAMS = {"velocity_threshold": 10.0, "min_duration": 20.0, "smooth": False}
GAP = 20.0

SLOW = trace_cte("frame_idx * 10.0")


def raw_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return ep.segment_episodes(fixtures.slow_trace(spark, sf), **PARAMS)


def merged(trace: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    return ep.find_episodes(trace, merge_gap=GAP, **PARAMS, rows=rows)


def motion_of(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    trace = stage(fixtures.slow_trace(spark, sf))
    found = stage(merged(trace, rows))
    return found, ep.episode_motion(stage(ep.episode_points(trace, found, rows)), rows)


def features_of(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    found, motion = motion_of(spark, sf, rows)
    return ep.episode_features(found, motion)


VELOCITY_CTE = """ve0 AS (SELECT *, LEAD(ts) OVER p AS nts, LEAD(x) OVER p AS nx, LEAD(y) OVER p AS ny, LEAD(z) OVER p AS nz
  FROM trace WINDOW p AS (PARTITION BY session_id, hand ORDER BY frame_idx)),
ve AS (SELECT *, COALESCE(CASE WHEN nts - ts > 0 THEN SQRT((nx-x)*(nx-x)+(ny-y)*(ny-y)+(nz-z)*(nz-z)) / (nts - ts) END, 0.0)
  AS velocity FROM ve0 WHERE nts IS NOT NULL)"""


def _fit(weights, offsets) -> str:
    at = lambda k: "velocity" if k == 0 else (f"LAG(velocity, {-k}) OVER p" if k < 0 else f"LEAD(velocity, {k}) OVER p")
    return "(" + " + ".join(f"({w}.0) * {at(k)}" for w, k in zip(weights, offsets)) + ") / 35.0"


SMOOTH_CTE = f"""sv0 AS (SELECT *, COUNT(*) OVER (PARTITION BY session_id, hand) AS n FROM ve),
sv AS (SELECT *, CASE WHEN n <= 5 THEN velocity
  WHEN frame_idx = 0 THEN {_fit((31, 9, -3, -5, 3), range(0, 5))}
  WHEN frame_idx = 1 THEN {_fit((9, 13, 12, 6, -5), range(-1, 4))}
  WHEN frame_idx = n - 1 THEN {_fit((3, -5, -3, 9, 31), range(-4, 1))}
  WHEN frame_idx = n - 2 THEN {_fit((-5, 6, 12, 13, 9), range(-3, 2))}
  ELSE {_fit((-3, 12, 17, 12, -3), range(-2, 3))} END AS smooth
  FROM sv0 WINDOW p AS (PARTITION BY session_id, hand ORDER BY frame_idx))"""


def episodes_cte(source: str = "ve", speed: str = "velocity", threshold: float = 10.0, shortest: float = 20.0,
                 gap: float = GAP) -> str:
    return f"""eb AS (SELECT *, {speed} > {threshold} AS active,
   COALESCE(LAG({speed}) OVER p > {threshold}, FALSE) AS was FROM {source}
   WINDOW p AS (PARTITION BY session_id, hand ORDER BY frame_idx)),
ec AS (SELECT *, SUM(CASE WHEN active AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, hand ORDER BY frame_idx)
   AS run FROM eb),
raw_ep AS (SELECT session_id, hand, MIN(frame_idx) AS start_frame, MAX(frame_idx) AS end_frame, MIN(ts) AS start_time,
   MAX(ts) AS end_time FROM ec WHERE active GROUP BY session_id, hand, run HAVING MAX(ts) - MIN(ts) >= {shortest}),
eg AS (SELECT *, CASE WHEN start_time - LAG(end_time) OVER (PARTITION BY session_id, hand ORDER BY start_frame) <= {gap}
   THEN 0 ELSE 1 END AS o FROM raw_ep),
eh AS (SELECT *, SUM(o) OVER (PARTITION BY session_id, hand ORDER BY start_frame) AS g FROM eg),
ep AS (SELECT session_id, hand, MIN(start_frame) AS start_frame, MAX(end_frame) AS end_frame, MIN(start_time) AS start_time,
   MAX(end_time) AS end_time FROM eh GROUP BY session_id, hand, g)"""


EPISODES_CTE = episodes_cte()

FEATURES_CTE = """pt0 AS (SELECT e.session_id, e.hand, e.start_frame, t.frame_idx, t.ts, t.x, t.y, t.z FROM ep e JOIN trace t
   ON t.session_id = e.session_id AND t.hand = e.hand AND t.frame_idx BETWEEN e.start_frame AND e.end_frame
   WHERE t.x IS NOT NULL),
pt1 AS (SELECT *, ROW_NUMBER() OVER p - 1 AS r, COUNT(*) OVER (PARTITION BY session_id, hand, start_frame) AS np,
   LEAD(ts) OVER p - ts AS dt, LEAD(x) OVER p - x AS dx, LEAD(y) OVER p - y AS dy, LEAD(z) OVER p - z AS dz
   FROM pt0 WINDOW p AS (PARTITION BY session_id, hand, start_frame ORDER BY frame_idx)),
pt2 AS (SELECT *, SQRT(dx*dx+dy*dy+dz*dz) AS step, CASE WHEN dt > 0 THEN SQRT(dx*dx+dy*dy+dz*dz)/dt END AS v FROM pt1),
pt3 AS (SELECT *, (LEAD(v) OVER p - v)/dt AS a,
   COALESCE(CAST(SIGN(LEAD(dx) OVER p) <> SIGN(dx) AS INT), 0) + COALESCE(CAST(SIGN(LEAD(dy) OVER p) <> SIGN(dy) AS INT), 0)
   + COALESCE(CAST(SIGN(LEAD(dz) OVER p) <> SIGN(dz) AS INT), 0) AS rev
   FROM pt2 WINDOW p AS (PARTITION BY session_id, hand, start_frame ORDER BY r)),
pt4 AS (SELECT *, (LEAD(a) OVER p - a)/dt AS j FROM pt3
   WINDOW p AS (PARTITION BY session_id, hand, start_frame ORDER BY r)),
fs AS (SELECT session_id, hand, start_frame,
   AVG(v) AS mean_velocity, MAX(v) AS max_velocity, VAR_POP(v) AS velocity_variance,
   AVG(ABS(a)) AS mean_acceleration, VAR_POP(a) AS acceleration_variance, AVG(ABS(j)) AS jerk_magnitude,
   SUM(step) AS path_length,
   SQRT(POWER(ARG_MAX(x,r)-ARG_MIN(x,r),2)+POWER(ARG_MAX(y,r)-ARG_MIN(y,r),2)+POWER(ARG_MAX(z,r)-ARG_MIN(z,r),2)) AS direct,
   SQRT((VAR_POP(x)+VAR_POP(y))/2 + POWER(AVG(x)-AVG(y),2)/4) AS spatial_spread_xy, STDDEV_POP(z) AS spatial_spread_z,
   MAX(v) FILTER (r < GREATEST(1, CAST(FLOOR((np-1)*0.3::DOUBLE) AS INT))) AS initiation_velocity,
   AVG(v) FILTER (r >= CAST(FLOOR((np-1)*0.8::DOUBLE) AS INT)) AS retraction_velocity,
   CAST(SUM(rev) AS DOUBLE) AS reversal_count,
   AVG(CASE WHEN v < 0.02 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END) AS dwell_ratio,
   SUM(v*v*dt) AS effort_proxy FROM pt4 WHERE np >= 2 GROUP BY ALL),
ft0 AS (SELECT ep.*, COALESCE(mean_velocity,0) AS mean_velocity, COALESCE(max_velocity,0) AS max_velocity,
   COALESCE(velocity_variance,0) AS velocity_variance, COALESCE(mean_acceleration,0) AS mean_acceleration,
   COALESCE(acceleration_variance,0) AS acceleration_variance, COALESCE(jerk_magnitude,0) AS jerk_magnitude,
   COALESCE(path_length,0) AS path_length,
   CASE WHEN fs.session_id IS NULL THEN 0.0 WHEN direct > 0 THEN direct / path_length ELSE 1.0 END AS path_efficiency,
   COALESCE(spatial_spread_xy,0) AS spatial_spread_xy, COALESCE(spatial_spread_z,0) AS spatial_spread_z,
   COALESCE(initiation_velocity,0) AS initiation_velocity, COALESCE(retraction_velocity,0) AS retraction_velocity,
   COALESCE(reversal_count,0) AS reversal_count, COALESCE(dwell_ratio,0) AS dwell_ratio,
   COALESCE(reversal_count*0.1::DOUBLE + dwell_ratio,0) AS hesitation_index, COALESCE(effort_proxy,0) AS effort_proxy,
   ep.end_time - ep.start_time AS duration, ep.end_frame - ep.start_frame + 1 AS num_frames
   FROM ep LEFT JOIN fs USING (session_id, hand, start_frame)),
ft AS (SELECT *, CASE WHEN mean_velocity < 0.03 THEN 'rest' WHEN initiation_velocity > 0.15 THEN 'reach'
   WHEN path_efficiency > 0.7 THEN 'direct_action' WHEN reversal_count > 5 THEN 'exploratory' ELSE 'manipulation' END
   AS episode_type, GREATEST(0.0, LEAST(1.0, 1.0/(1.0+hesitation_index))) AS confidence FROM ft0)"""

SPEECH_CTE = """speech AS (SELECT session_id, seg_idx, before / 15.0 AS start_s, before / 15.0 + chars / 15.0 AS end_s, text FROM (
   SELECT conv_id AS session_id, turn AS seg_idx, text, LENGTH(text) AS chars,
   CAST(COALESCE(SUM(LENGTH(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
   AS DOUBLE) AS before FROM conversations))"""

BOUNDS = ["session_id", "hand", "start_frame", "end_frame"]
BOUNDS_SQL = "session_id, hand, start_frame, end_frame"


def bounds(df: DataFrame) -> DataFrame:
    return df.select(*BOUNDS, r("start_time"), r("end_time"))


@query("episode_velocity", with_([SLOW, VELOCITY_CTE, SMOOTH_CTE],
       f"SELECT session_id, hand, frame_idx, {sr('velocity')}, {sr('smooth')} FROM sv"))
def episode_velocity(spark: SparkSession, sf: str) -> DataFrame:
    out = ep.velocities(fixtures.slow_trace(spark, sf))
    return out.select("session_id", "hand", "frame_idx", r("velocity"), r("smooth"))


@query("episodes_unmerged", with_([SLOW, VELOCITY_CTE, EPISODES_CTE],
       f"SELECT {BOUNDS_SQL}, {sr('start_time')}, {sr('end_time')} FROM raw_ep"))
def episodes_unmerged(spark: SparkSession, sf: str) -> DataFrame:
    return bounds(raw_episodes(spark, sf))


@query("episodes", with_([SLOW, VELOCITY_CTE, EPISODES_CTE],
       f"SELECT {BOUNDS_SQL}, {sr('start_time')}, {sr('end_time')} FROM ep"))
def episodes(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    return bounds(merged(fixtures.slow_trace(spark, sf), rows))


@query("episodes_smoothed", with_([trace_cte(), VELOCITY_CTE, SMOOTH_CTE,
       episodes_cte("sv", "smooth", 4000.0, 0.06, 0.05)],
       f"SELECT {BOUNDS_SQL}, {sr('start_time')}, {sr('end_time')} FROM ep"))
def episodes_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    return bounds(ep.find_episodes(fixtures.trace(spark, sf), 4000.0, 0.06, 0.05))


@query("episodes_defaults", with_([trace_cte(), VELOCITY_CTE, SMOOTH_CTE, episodes_cte("sv", "smooth", 0.05, 0.3, 0.2)],
       f"SELECT {BOUNDS_SQL}, {sr('start_time')}, {sr('end_time')} FROM ep"))
def episodes_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return bounds(ep.find_episodes(fixtures.trace(spark, sf)))


ID = ["session_id", "hand", "start_frame"]


@query("episode_kinematics", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, FEATURES_CTE],
       "SELECT session_id, hand, start_frame, " + ", ".join(sr(c, digits=5) for c in ep.KINEMATIC) + " FROM ft"))
def episode_kinematics(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    return features_of(spark, sf, rows).select(*ID, *[r(c, 5) for c in ep.KINEMATIC])


@query("episode_intent", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, FEATURES_CTE],
       "SELECT session_id, hand, start_frame, " + ", ".join(sr(c, digits=5) for c in ep.INTENT) + " FROM ft"))
def episode_intent(spark: SparkSession, sf: str) -> DataFrame:
    return features_of(spark, sf).select(*ID, *[r(c, 5) for c in ep.INTENT])


@query("episode_types", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, FEATURES_CTE],
       f"SELECT session_id, hand, start_frame, episode_type, {sr('confidence')} FROM ft"))
def episode_types(spark: SparkSession, sf: str) -> DataFrame:
    return features_of(spark, sf).select(*ID, "episode_type", r("confidence"))


_COUNTS = ", ".join(f"COUNT(*) FILTER (episode_type = '{t}') AS {t}" for t in ep.TYPES)


@query("episode_metrics", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, FEATURES_CTE,
       "hands AS (SELECT DISTINCT user_id AS session_id, h.hand FROM events, (VALUES ('left'), ('right')) h(hand))"],
       f"""SELECT h.session_id, h.hand, COUNT(ft.start_frame) AS count, {sr('COALESCE(AVG(duration),0)', 'avg_duration')},
       {sr('COALESCE(AVG(confidence),0)', 'avg_confidence')}, {_COUNTS} FROM hands h LEFT JOIN ft USING (session_id, hand)
       GROUP BY ALL"""))
def episode_metrics(spark: SparkSession, sf: str) -> DataFrame:
    sessions = fixtures.read(spark, sf, "events").select(F.col("user_id").alias("session_id"))
    out = ep.episode_metrics(features_of(spark, sf), sessions)
    return out.select("session_id", "hand", "count", r("avg_duration"), r("avg_confidence"), *ep.TYPES)


@query("episode_type_totals", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, FEATURES_CTE],
       """SELECT episode_type, session_id, hand, COUNT(*) AS episodes, CAST(GROUPING_ID(episode_type, session_id, hand) AS INT) AS totals FROM ft
       GROUP BY GROUPING SETS ((episode_type), (episode_type, session_id), (episode_type, session_id, hand))"""))
def episode_type_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = ep.episode_type_totals(features_of(spark, sf))
    return out.select("episode_type", "session_id", "hand", "episodes", "totals")


#: Spectral arc length by a Fourier sum; no episode of the test tables has more than one window of 256 speeds.
SPARC_CTE = """sp0 AS (SELECT session_id, hand, start_frame, v, ts, ROW_NUMBER() OVER p - 1 AS j, COUNT(*) OVER q AS n, v - AVG(v) OVER q AS d
   FROM pt2 WHERE v IS NOT NULL WINDOW p AS (PARTITION BY session_id, hand, start_frame ORDER BY r), q AS (PARTITION BY session_id, hand, start_frame)),
sp1 AS (SELECT session_id, hand, start_frame, n, f, SUM(d * (0.5 - 0.5 * COS(2 * PI() * j / n)) * COS(2 * PI() * f * j / n)) AS re,
   SUM(d * (0.5 - 0.5 * COS(2 * PI() * j / n)) * SIN(2 * PI() * f * j / n)) AS im, (n - 1) / (MAX(ts) - MIN(ts)) / n AS width
   FROM sp0, UNNEST(RANGE(0, n // 2 + 1)) u(f) WHERE n BETWEEN 4 AND 255 GROUP BY session_id, hand, start_frame, n, f),
sp2 AS (SELECT *, (re * re + im * im) * CASE WHEN f = 0 OR (n % 2 = 0 AND f = n // 2) THEN 1 ELSE 2 END AS power FROM sp1),
sp3 AS (SELECT *, (power - LAG(power) OVER p) / SUM(power) OVER q AS change FROM sp2 WINDOW p AS (PARTITION BY session_id, hand, start_frame ORDER BY f),
   q AS (PARTITION BY session_id, hand, start_frame)),
sp AS (SELECT session_id, hand, start_frame, SUM(SQRT(width * width + change * change)) AS arc FROM sp3 WHERE change IS NOT NULL GROUP BY ALL)"""


@query("episode_smoothness", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, FEATURES_CTE, SPARC_CTE],
       f"SELECT session_id, hand, start_frame, {sr('COALESCE(arc, 0)', 'smoothness_sparc', 5)} FROM ep LEFT JOIN sp USING (session_id, hand, start_frame)"))
def episode_smoothness(spark: SparkSession, sf: str) -> DataFrame:
    found, motion = motion_of(spark, sf)
    return ep.with_sparc(found, stage(motion)).select(*ID, r("smoothness_sparc", 5))


_EMBED = [c for c in ep.EMBEDDED if c != "smoothness_sparc"]


@query("episode_embedding", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, FEATURES_CTE,
       "em0 AS (SELECT session_id, hand, start_frame, ["
       + ", ".join("0.0::DOUBLE" if c == "smoothness_sparc" else f"CAST(CAST({c} AS FLOAT) AS DOUBLE)" for c in ep.EMBEDDED)
       + "] AS f FROM ft)",
       "em AS (SELECT *, SQRT(LIST_SUM(LIST_TRANSFORM(f, lambda v: v*v))) AS norm FROM em0)"],
       "SELECT session_id, hand, start_frame, "
       + ", ".join(f"ROUND(CASE WHEN norm > 0 THEN f[{i}]/norm ELSE f[{i}] END, 4) + 0.0 AS e{i}" for i in range(1, 14))
       + ", 32 AS dim FROM em"))
def episode_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Without the spectral feature, which plain SQL cannot express (see ``episode_map`` for all features)."""
    out = ep.episode_embedding(features_of(spark, sf).withColumn("smoothness_sparc", F.lit(0.0)))
    cells = [r(F.col("embedding")[i - 1], 4, f"e{i}") for i in range(1, 14)]
    return out.select(*ID, *cells, F.size("embedding").alias("dim"))


@query("speech_alignment", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, SPEECH_CTE],
       f"""SELECT e.session_id, hand, start_frame, seg_idx, {sr('(LEAST(end_s,end_time)-GREATEST(start_s,start_time))/(end_s-start_s)',
       'overlap_ratio')} FROM ep e JOIN speech s ON s.session_id = e.session_id AND NOT (end_s < start_time OR start_s > end_time)
       WHERE end_s > start_s AND (LEAST(end_s,end_time)-GREATEST(start_s,start_time))/(end_s-start_s) > 0.2"""))
def speech_alignment(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lookups.align_speech(merged(fixtures.slow_trace(spark, sf)), fixtures.transcript(spark, sf))
    return pairs.select(*ID, "seg_idx", r("overlap_ratio"))


@query("episodes_with_speech", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, SPEECH_CTE,
       """al AS (SELECT e.session_id, hand, start_frame, seg_idx, text FROM ep e JOIN speech s ON s.session_id = e.session_id
       AND NOT (end_s < start_time OR start_s > end_time) WHERE end_s > start_s
       AND (LEAST(end_s,end_time)-GREATEST(start_s,start_time))/(end_s-start_s) > 0.2)"""],
       """SELECT e.session_id, e.hand, e.start_frame, COUNT(al.seg_idx) AS segments,
       COALESCE(STRING_AGG(text, '|' ORDER BY seg_idx), '') AS spoken FROM ep e LEFT JOIN al USING (session_id, hand, start_frame)
       GROUP BY ALL"""))
def episodes_with_speech(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(merged(fixtures.slow_trace(spark, sf)))
    out = lookups.aligned_speech(found, lookups.align_speech(found, fixtures.transcript(spark, sf)))
    spoken = F.array_join(F.transform("aligned_speech", lambda s: s["text"]), "|")
    return out.select(*ID, F.size("aligned_speech").cast("bigint").alias("segments"), spoken.alias("spoken"))


@query("spoken_episodes", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, SPEECH_CTE,
       """al AS (SELECT e.session_id, hand, start_frame, start_time, end_time, seg_idx, text FROM ep e JOIN speech s
       ON s.session_id = e.session_id AND NOT (end_s < start_time OR start_s > end_time) WHERE end_s > start_s
       AND (LEAST(end_s,end_time)-GREATEST(start_s,start_time))/(end_s-start_s) > 0.2)""",
       """told AS (SELECT session_id, hand, start_frame, start_time, end_time, COUNT(*) AS segments,
       STRING_AGG(text, '|' ORDER BY seg_idx) AS spoken FROM al GROUP BY ALL)""",
       """ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY start_time, hand, start_frame) - 1 AS lane FROM told)"""],
       f"""SELECT session_id, hand, start_frame, lane, {sr('start_time')}, {sr('end_time - start_time', 'duration')}, segments, spoken
       FROM ranked WHERE lane < 20"""))
def spoken_episodes(spark: SparkSession, sf: str) -> DataFrame:
    found = stage(merged(fixtures.slow_trace(spark, sf)))
    pairs = stage(lookups.align_speech(found, fixtures.transcript(spark, sf)))
    out = lookups.spoken_episodes(found, pairs)
    spoken = F.array_join(F.transform("aligned_speech", lambda s: s["text"]), "|")
    length = (F.col("end_time") - F.col("start_time")).alias("duration")
    return out.select(*ID, "lane", r("start_time"), r(length, alias="duration"), F.size("aligned_speech").cast("bigint").alias("segments"), spoken.alias("spoken"))


GESTURE_FRAMES_CTE = """gf AS (SELECT user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand,
   event_type AS gesture, ROW_NUMBER() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS frame_idx FROM events)"""


def gesture_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Gestures of F6 on the frame numbers of F1."""
    from kinescribe.plans.chunks import dense_index

    rows = fixtures.gestures(spark, sf)
    return dense_index(rows, ["session_id", "hand"], fixtures.minute_of("ts"), ["ts", "event_id"], "frame_idx")


@query("context_at", with_([GESTURE_FRAMES_CTE, SPEECH_CTE,
       "asked AS (SELECT DISTINCT session_id, start_s + 1.0 AS time_s FROM speech)",
       """said AS (SELECT a.session_id, a.time_s, ARG_MIN(s.text, s.seg_idx) AS spoken FROM asked a LEFT JOIN speech s
       ON s.session_id = a.session_id AND s.start_s <= a.time_s AND a.time_s < s.end_s GROUP BY ALL)"""],
       f"""SELECT a.session_id, {sr('a.time_s', 'time_s')}, COALESCE(l.gesture, 'None') AS gesture_left,
       COALESCE(g.gesture, 'None') AS gesture_right, COALESCE(a.spoken, '') AS spoken FROM said a
       LEFT JOIN gf l ON l.session_id = a.session_id AND l.hand = 'left' AND l.frame_idx = CAST(FLOOR(a.time_s * 0.1::DOUBLE) AS BIGINT)
       LEFT JOIN gf g ON g.session_id = a.session_id AND g.hand = 'right' AND g.frame_idx = CAST(FLOOR(a.time_s * 0.1::DOUBLE) AS BIGINT)"""))
def context_at(spark: SparkSession, sf: str) -> DataFrame:
    said = fixtures.transcript(spark, sf)
    times = said.select("session_id", (F.col("start_s") + 1.0).alias("time_s"))
    out = lookups.context_at(times, gesture_frames(spark, sf), said, fps=0.1)
    return out.withColumn("time_s", r("time_s"))


@query("episode_at", with_([SLOW, VELOCITY_CTE, EPISODES_CTE, SPEECH_CTE,
       "q AS (SELECT s.session_id, h.hand, s.start_s AS time_s, s.seg_idx FROM speech s, (VALUES ('left'), ('right')) h(hand))"],
       """SELECT q.session_id, q.hand, q.seg_idx, MIN(e.start_frame) AS start_frame FROM q LEFT JOIN ep e ON
       e.session_id = q.session_id AND e.hand = q.hand AND q.time_s BETWEEN e.start_time AND e.end_time GROUP BY ALL"""))
def episode_at(spark: SparkSession, sf: str) -> DataFrame:
    both = F.explode(F.array(F.lit("left"), F.lit("right")))
    times = fixtures.transcript(spark, sf).select(
        "session_id", both.alias("hand"), F.col("start_s").alias("time_s"), "seg_idx"
    )
    out = lookups.episode_at(times, merged(fixtures.slow_trace(spark, sf)))
    return out.select("session_id", "hand", "seg_idx", F.col("found.start_frame").alias("start_frame"))


@query("sentence_at", with_([SLOW, SPEECH_CTE],
       """SELECT t.session_id, t.hand, t.frame_idx, MIN(s.seg_idx) AS seg_idx FROM trace t LEFT JOIN speech s
       ON s.session_id = t.session_id AND t.ts BETWEEN s.start_s AND s.end_s GROUP BY ALL"""))
def sentence_at(spark: SparkSession, sf: str) -> DataFrame:
    times = fixtures.slow_trace(spark, sf).select("session_id", "hand", "frame_idx", F.col("ts").alias("time_s"))
    out = lookups.sentence_at(times, fixtures.transcript(spark, sf))
    return out.select("session_id", "hand", "frame_idx", F.col("found.seg_idx").alias("seg_idx"))


@query("trail", with_([SLOW, SPEECH_CTE,
       "rq AS (SELECT DISTINCT session_id, CAST(FLOOR(end_s * 0.1::DOUBLE) AS BIGINT) AS at_frame FROM speech)",
       """lk AS (SELECT session_id, hand, frame_idx, x, y, LEAD(x) OVER p AS next_x, LEAD(y) OVER p AS next_y FROM trace
       WINDOW p AS (PARTITION BY session_id, hand ORDER BY frame_idx))"""],
       f"""SELECT lk.session_id, lk.hand, at_frame, frame_idx, {sr('x')}, {sr('y')}, {sr('next_x')}, {sr('next_y')} FROM rq
       JOIN lk ON lk.session_id = rq.session_id AND frame_idx BETWEEN at_frame - 50 AND at_frame - 1
       WHERE x IS NOT NULL AND next_x IS NOT NULL"""))
def trail(spark: SparkSession, sf: str) -> DataFrame:
    both = F.explode(F.array(F.lit("left"), F.lit("right")))
    frame = (F.col("end_s") * 0.1).cast("bigint")
    asked = fixtures.transcript(spark, sf).select("session_id", both.alias("hand"), frame.alias("frame_idx")).distinct()
    out = lookups.trail(asked, fixtures.slow_trace(spark, sf))
    return out.select("session_id", "hand", "at_frame", "frame_idx", r("x"), r("y"), r("next_x"), r("next_y"))
