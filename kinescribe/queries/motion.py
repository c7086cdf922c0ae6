"""Trace cleaning, speed and phase queries over the event trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe import fixtures
from kinescribe.operators import traces
from kinescribe.plans.chunks import CHUNK_ROWS
from kinescribe.plans.staging import stage
from kinescribe.queries.base import FILTERED_CTE, query, r, sr, trace_cte, with_

FPS = 30.0
DIM = {"width": fixtures.WIDTH, "height": fixtures.HEIGHT}
#: The fixture positions are random, so the defaults would keep almost nothing.
LOOSE = {"min_len": 3, "max_jump_pct": 0.25}

TRACE = trace_cte()


def filtered(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    return traces.filter_trace(fixtures.trace(spark, sf), **DIM, **LOOSE, rows=rows)


def derived(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    return traces.derivatives(stage(filtered(spark, sf, rows)), FPS, rows)


def phased(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    return traces.phases(stage(derived(spark, sf, rows)))


def xyz_out(df: DataFrame, *extra) -> DataFrame:
    return df.select("session_id", "hand", "frame_idx", r("x"), r("y"), r("z"), *extra)


XYZ = f"session_id, hand, frame_idx, {sr('x')}, {sr('y')}, {sr('z')}"

STEPS_CTE = """st0 AS (
  SELECT *, COALESCE(SQRT(POWER(x - LAG(x) OVER p, 2) + POWER(y - LAG(y) OVER p, 2)), 0.0) AS step
  FROM filtered WINDOW p AS (PARTITION BY session_id, hand ORDER BY frame_idx)),
st AS (SELECT * FROM st0 WHERE frame_idx > 0),
sm AS (SELECT *, MEDIAN(step) OVER (PARTITION BY session_id, hand ORDER BY frame_idx
         ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS speed FROM st)"""

PHASE_CTE = """v0 AS (
  SELECT session_id, hand, frame_idx, x, y, z,
         ROW_NUMBER() OVER (PARTITION BY session_id, hand ORDER BY frame_idx) - 1 AS n,
         COUNT(*) OVER (PARTITION BY session_id, hand) AS points
  FROM filtered WHERE x IS NOT NULL),
v1 AS (
  SELECT *, LAG(x) OVER p AS bx, LAG(y) OVER p AS by_, LAG(z) OVER p AS bz,
         LEAD(x) OVER p AS ax, LEAD(y) OVER p AS ay, LEAD(z) OVER p AS az
  FROM v0 WHERE points >= 5 WINDOW p AS (PARTITION BY session_id, hand ORDER BY n)),
v2 AS (SELECT *, SQRT((x-bx)*(x-bx)+(y-by_)*(y-by_)+(z-bz)*(z-bz)) AS step FROM v1),
v3 AS (SELECT *, COALESCE(step / (1.0/30.0), 0.0) AS speed FROM v2),
v4 AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE (speed - LAG(speed) OVER (PARTITION BY session_id, hand ORDER BY n))
         / (1.0/30.0) END AS accel FROM v3),
v5 AS (SELECT *, CASE WHEN n < 3 THEN 0.0 ELSE ABS((accel - LAG(accel) OVER (PARTITION BY session_id, hand ORDER BY n))
         / (1.0/30.0)) END AS jerk, MAX(speed) OVER (PARTITION BY session_id, hand) AS top FROM v4),
ph AS (SELECT *, CASE WHEN speed < top * 0.1 THEN 0 WHEN speed > top * 0.4 THEN 1 ELSE 2 END AS phase FROM v5),
full_phase AS (SELECT f.session_id, f.hand, f.frame_idx, COALESCE(ph.phase, -1) AS phase
  FROM filtered f LEFT JOIN ph USING (session_id, hand, frame_idx))"""

REACH_CTE = """rr0 AS (SELECT *, CASE WHEN phase = 1 AND COALESCE(LAG(phase) OVER p, -9) <> 1 THEN 1 ELSE 0 END AS o
  FROM ph WINDOW p AS (PARTITION BY session_id, hand ORDER BY n)),
rr1 AS (SELECT *, SUM(o) OVER (PARTITION BY session_id, hand ORDER BY n) AS run FROM rr0),
rr2 AS (SELECT session_id, hand, run, MIN(n) AS first_n, SUM(step) AS path,
   ARG_MIN(bx, n) AS sx, ARG_MIN(by_, n) AS sy, ARG_MIN(bz, n) AS sz, MAX(n) AS last_n FROM rr1 WHERE phase = 1
   GROUP BY 1, 2, 3),
reach AS (SELECT a.session_id, a.hand, a.first_n, a.path,
   SQRT(POWER(e.x-a.sx,2)+POWER(e.y-a.sy,2)+POWER(e.z-a.sz,2)) AS displacement
   FROM rr2 a JOIN ph e ON e.session_id = a.session_id AND e.hand = a.hand AND e.n = a.last_n + 1),
hmi AS (SELECT b.*, COALESCE(t.tortuosity, 1.0) AS tortuosity FROM
  (SELECT session_id, hand, COUNT(*) FILTER (phase = 0) AS rest, COUNT(*) FILTER (phase = 1) AS reach,
     COUNT(*) FILTER (phase = 2) AS hover, AVG(jerk) AS avg_jerk FROM ph GROUP BY 1, 2) b
  LEFT JOIN (SELECT session_id, hand, AVG(path/displacement) AS tortuosity FROM reach WHERE displacement > 10
     GROUP BY 1, 2) t USING (session_id, hand))"""

METRICS_CTE = """metrics AS (SELECT session_id, hand, SUM(step) AS total_distance, MAX(speed) AS max_speed,
  AVG(speed) AS avg_speed FROM sm GROUP BY 1, 2)"""


@query("motion_metrics", with_([TRACE, FILTERED_CTE, STEPS_CTE, METRICS_CTE],
       f"SELECT session_id, hand, {sr('total_distance')}, {sr('max_speed')}, {sr('avg_speed')} FROM metrics"))
def motion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = traces.motion_metrics(traces.speeds(fixtures.trace(spark, sf), **DIM, **LOOSE))
    return out.select("session_id", "hand", r("total_distance"), r("max_speed"), r("avg_speed"))


@query("trace_filtered", with_([TRACE, FILTERED_CTE], f"SELECT {XYZ} FROM filtered"))
def trace_filtered(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    return xyz_out(filtered(spark, sf, rows))


@query("trace_filtered_defaults", with_([TRACE, FILTERED_CTE.replace("0.25 *", "0.1 *").replace("n >= 3", "n >= 5")],
       f"SELECT {XYZ} FROM filtered"))
def trace_filtered_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return xyz_out(traces.filter_trace(fixtures.trace(spark, sf), **DIM))


@query("step_speeds", with_([TRACE, FILTERED_CTE, STEPS_CTE],
       f"SELECT session_id, hand, frame_idx, {sr('step')}, {sr('speed')} FROM sm"))
def step_speeds(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    out = traces.speeds(fixtures.trace(spark, sf), **DIM, **LOOSE, rows=rows)
    return out.select("session_id", "hand", "frame_idx", r("step"), r("speed"))


@query("frame_chunks", with_([TRACE], """SELECT session_id, hand, CAST(FLOOR(frame_idx / 6) AS BIGINT) AS chunk_idx,
  COUNT(*) AS frames, COUNT(x) AS seen FROM trace GROUP BY ALL"""))
def frame_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunked = traces.frame_chunks(fixtures.slow_trace(spark, sf), fps=0.1, seconds=60)
    return chunked.groupBy("session_id", "hand", "chunk_idx").agg(
        F.count(F.lit(1)).alias("frames"), F.count("x").alias("seen")
    )


@query("derivatives", with_([TRACE, FILTERED_CTE, PHASE_CTE],
       f"SELECT session_id, hand, frame_idx, n, {sr('speed')}, {sr('accel', digits=3)}, {sr('jerk', digits=2)} FROM ph"))
def derivatives(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    out = derived(spark, sf, rows)
    return out.select("session_id", "hand", "frame_idx", "n", r("speed"), r("accel", 3), r("jerk", 2))


@query("phase_labels", with_([TRACE, FILTERED_CTE, PHASE_CTE], "SELECT * FROM full_phase"))
def phase_labels(spark: SparkSession, sf: str) -> DataFrame:
    return traces.phase_label(fixtures.trace(spark, sf), phased(spark, sf))


@query("hmi_metrics", with_([TRACE, FILTERED_CTE, PHASE_CTE, REACH_CTE],
       f"SELECT session_id, hand, rest, reach, hover, {sr('avg_jerk', digits=2)}, {sr('tortuosity')} FROM hmi"))
def hmi_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = traces.hmi_metrics(stage(phased(spark, sf)))
    return out.select("session_id", "hand", "rest", "reach", "hover", r("avg_jerk", 2), r("tortuosity"))


@query("reach_runs", with_([TRACE, FILTERED_CTE, PHASE_CTE, REACH_CTE],
       f"SELECT session_id, hand, first_n, {sr('path')}, {sr('displacement')} FROM reach"))
def reach_runs(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    return traces.reach_runs(phased(spark, sf, rows), rows).select("session_id", "hand", "first_n", r("path"), r("displacement"))


@query("hover_hotspots", with_([TRACE, FILTERED_CTE, PHASE_CTE], f"SELECT {XYZ} FROM ph WHERE phase = 2"))
def hover_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return xyz_out(traces.hover_hotspots(phased(spark, sf)))


_RUNS = """r0 AS (SELECT *, CASE WHEN {same} THEN 0 ELSE 1 END AS o FROM {table}
   WINDOW p AS (PARTITION BY session_id, hand ORDER BY frame_idx)),
r1 AS (SELECT *, SUM(o) OVER (PARTITION BY session_id, hand ORDER BY frame_idx) AS run FROM r0)"""


@query("phase_runs", with_([TRACE, FILTERED_CTE, PHASE_CTE,
       _RUNS.format(same="LAG(phase) OVER p = phase", table="full_phase")],
       f"""SELECT session_id, hand, MIN(phase) AS phase, {sr('MIN(frame_idx)/30.0', 'start_s')},
       {sr('COUNT(*)/30.0', 'duration_s')} FROM r1 GROUP BY session_id, hand, run"""))
def phase_runs(spark: SparkSession, sf: str, rows: int = CHUNK_ROWS) -> DataFrame:
    labelled = traces.phase_label(fixtures.trace(spark, sf), phased(spark, sf, rows))
    out = traces.phase_runs(labelled, FPS, rows)
    return out.select("session_id", "hand", "phase", r("start_s"), r("duration_s"))


@query("presence_runs", with_([TRACE, FILTERED_CTE, _RUNS.format(same="LAG(x) OVER p IS NOT NULL", table="filtered")],
       f"""SELECT session_id, hand, {sr('MIN(frame_idx)/30.0', 'start_s')}, {sr('COUNT(*)/30.0', 'duration_s')}
       FROM r1 WHERE x IS NOT NULL GROUP BY session_id, hand, run"""))
def presence_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = traces.presence_runs(filtered(spark, sf), FPS)
    return out.select("session_id", "hand", r("start_s"), r("duration_s"))


_SIDES = ", ".join(
    sr(f"COALESCE(MAX({source}) FILTER (hand = '{hand}'), 0.0)", f"{name}_{hand}", digits)
    for source, name, digits in (("avg_speed", "speed", 6), ("tortuosity", "tortuosity", 6), ("avg_jerk", "jerk", 2))
    for hand in ("left", "right")
)


@query("performance_comparison", with_([TRACE, FILTERED_CTE, STEPS_CTE, METRICS_CTE, PHASE_CTE, REACH_CTE,
       f"""wide AS (SELECT session_id, {_SIDES}, AVG(tortuosity) AS mt FROM metrics m
       LEFT JOIN hmi USING (session_id, hand) GROUP BY session_id)"""],
       f"SELECT * EXCLUDE (mt), {sr('mt', 'mean_tortuosity')}, "
       "COALESCE(mt = (SELECT MIN(mt) FROM wide), FALSE) AS is_best FROM wide"))
def performance_comparison(spark: SparkSession, sf: str) -> DataFrame:
    metrics = stage(traces.motion_metrics(traces.speeds(fixtures.trace(spark, sf), **DIM, **LOOSE)))
    out = traces.performance_comparison(metrics, stage(traces.hmi_metrics(stage(phased(spark, sf)))))
    sides = [f"{n}_{h}" for n in ("speed", "tortuosity") for h in ("left", "right")]
    return out.select(
        "session_id", *[r(c) for c in sides], r("jerk_left", 2), r("jerk_right", 2), r("mean_tortuosity"), "is_best"
    )
