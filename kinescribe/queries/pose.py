"""Landmark, gesture and grid queries over the vectors and the event trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe import fixtures
from kinescribe.functions import landmarks as lm
from kinescribe.operators import grids
from kinescribe.operators import landmarks as ops
from kinescribe.queries.base import FILTERED_CTE, query, r, sr, trace_cte, with_
from kinescribe.queries.motion import filtered

W, H = fixtures.WIDTH, fixtures.HEIGHT

Q = """em AS (SELECT CAST(label AS BIGINT) AS session_id, vec_id,
   LIST_TRANSFORM(embedding, lambda e: (CAST(e AS DOUBLE) + 1.0) / 2.0) AS q FROM embeddings)"""
HANDS = f"""{Q}, hf AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 'Left' ELSE 'Right' END AS hand,
   ROW_NUMBER() OVER (PARTITION BY session_id, vec_id % 2 ORDER BY vec_id) - 1 AS frame_idx FROM em)"""


def px(j: int) -> str:
    return f"q[{3 * j + 1}]"


def py(j: int) -> str:
    return f"q[{3 * j + 2}]"


def pz(j: int) -> str:
    return f"q[{3 * j + 3}]"


def d2(a: int, b: int) -> str:
    return f"SQRT(POWER({px(a)}-{px(b)},2)+POWER({py(a)}-{py(b)},2))"


def d3(a: int, b: int) -> str:
    return f"SQRT(POWER({px(a)}-{px(b)},2)+POWER({py(a)}-{py(b)},2)+POWER({pz(a)}-{pz(b)},2))"


def mean(indices, coordinate) -> str:
    return "(" + "+".join(coordinate(i) for i in indices) + f")/{len(list(indices))}.0"


DEPTH = f"1.0 / CASE WHEN {d3(0, 9)} = 0 THEN 0.001 ELSE {d3(0, 9)} END"


def _point_sql(source: str) -> str:
    if source in lm.TIPS:
        x, y = px(lm.TIPS[source]), py(lm.TIPS[source])
    else:
        indices = lm.PALM if source == "Whole Hand" else range(21)
        x, y = mean(indices, px), mean(indices, py)
    return (
        f"SELECT session_id, hand, frame_idx, '{source}' AS source, TRUNC({x} * 640.0) + 0.0 AS x, "
        f"TRUNC({y} * 480.0) + 0.0 AS y, {sr(DEPTH, 'z')} FROM hf"
    )


@query("trace_points", with_([HANDS], " UNION ALL ".join(_point_sql(s) for s in lm.HAND_SOURCES)))
def trace_points(spark: SparkSession, sf: str) -> DataFrame:
    """Tracked point of every detected hand, for all eight sources (one scan each row expanded)."""
    frames = fixtures.hand_frames(spark, sf)
    z = lm.depth_proxy("landmarks")
    tracked = []
    for source in lm.HAND_SOURCES:
        x, y = lm.trace_share("landmarks", source)
        tracked.append(F.struct(F.lit(source).alias("source"), lm.to_pixels(x, W).alias("x"), lm.to_pixels(y, H).alias("y")))
    out = frames.select("session_id", "hand", "frame_idx", F.explode(F.array(*tracked)).alias("t"), r(z, alias="z"))
    return out.select(
        "session_id", "hand", "frame_idx", "t.source", F.col("t.x").cast("double").alias("x"), F.col("t.y").cast("double").alias("y"), "z"
    )


@query("hand_trace", with_([HANDS, f"""pt AS (SELECT session_id, CASE WHEN hand = 'Left' THEN 'left' ELSE 'right' END AS hand, frame_idx,
       TRUNC({mean(lm.PALM, px)} * 640.0) AS x, TRUNC({mean(lm.PALM, py)} * 480.0) AS y, {DEPTH} AS z FROM hf)""",
       "ss AS (SELECT session_id, MAX(frame_idx) + 1 AS n FROM hf GROUP BY 1)",
       """sp AS (SELECT session_id, h.hand, UNNEST(RANGE(n)) AS frame_idx FROM ss, (VALUES ('left'), ('right')) h(hand))"""],
       f"""SELECT sp.session_id, sp.hand, sp.frame_idx, {sr('sp.frame_idx / 25.0', 'ts')}, {sr('x')}, {sr('y')}, {sr('z')}
       FROM sp LEFT JOIN pt USING (session_id, hand, frame_idx)"""))
def hand_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Landmarks to a trace on the frame spine, both hands."""
    frames = fixtures.hand_frames(spark, sf)
    sessions = frames.groupBy("session_id").agg((F.max("frame_idx") + 1).alias("total_frames")).withColumn("fps", F.lit(25.0))
    points = ops.hand_pivot(ops.trace_points(frames, W, H))
    out = ops.build_trace(sessions, points)
    return out.select("session_id", "hand", "frame_idx", r("ts"), r("x"), r("y"), r("z"))


@query("sampled_frames", with_([HANDS], "SELECT session_id, hand, frame_idx, vec_id FROM hf WHERE frame_idx % 10 = 0"))
def sampled_frames(spark: SparkSession, sf: str) -> DataFrame:
    return ops.sample_frames(fixtures.hand_frames(spark, sf), 10).select("session_id", "hand", "frame_idx", "vec_id")


@query("frame_times", with_([HANDS], f"""SELECT session_id, hand, frame_idx, {sr('frame_idx / 29.97::DOUBLE', 'ts')},
       CAST(TRUNC(frame_idx * 1000.0 / 29.97::DOUBLE) AS BIGINT) AS ms FROM hf"""))
def frame_times(spark: SparkSession, sf: str) -> DataFrame:
    from kinescribe.functions.scalars import frame_ms, frame_time

    fps = F.lit(29.97)
    return fixtures.hand_frames(spark, sf).select(
        "session_id", "hand", "frame_idx", r(frame_time(F.col("frame_idx"), fps), alias="ts"),
        frame_ms(F.col("frame_idx"), fps).alias("ms"),
    )


def ext(f: str) -> str:
    tip, pip, mcp = lm.FINGERS[f]
    return f"({d2(tip, 0)} > 1.1::DOUBLE * {d2(pip, 0)} AND {py(tip)} < {py(mcp)})"


_GESTURE = f"""gs0 AS (SELECT session_id, hand, frame_idx, CAST({ext('index')} AS INT) AS i, CAST({ext('middle')} AS INT) AS m,
   CAST({ext('ring')} AS INT) AS g, CAST({ext('pinky')} AS INT) AS p, {py(4)} < {py(2)} - 0.05::DOUBLE AS up,
   {py(4)} > {py(2)} + 0.05::DOUBLE AS down FROM hf),
gs AS (SELECT session_id, hand, frame_idx, CASE WHEN i+m+g+p = 0 AND NOT up AND NOT down THEN 'Closed_Fist' WHEN i+m+g+p = 4 THEN 'Open_Palm'
   WHEN i = 1 AND i+m+g+p = 1 THEN 'Pointing_Up' WHEN i = 1 AND m = 1 AND g = 0 AND p = 0 THEN 'Victory'
   WHEN up AND i = 1 AND p = 1 AND m = 0 AND g = 0 THEN 'ILoveYou' WHEN up AND i+m+g+p = 0 THEN 'Thumb_Up'
   WHEN down AND i+m+g+p = 0 THEN 'Thumb_Down' END AS gesture FROM gs0)"""


@query("hand_gestures", with_([HANDS, _GESTURE], """SELECT *, CASE gesture WHEN 'Open_Palm' THEN 0.9::DOUBLE
       WHEN 'ILoveYou' THEN 0.8::DOUBLE WHEN NULL THEN NULL ELSE CASE WHEN gesture IS NOT NULL THEN 0.85::DOUBLE END END AS score FROM gs"""))
def hand_gestures(spark: SparkSession, sf: str) -> DataFrame:
    return ops.gesture_rows(fixtures.hand_frames(spark, sf))


_OUT = {t: f"CAST({d3(t, 0)} > {d3(j, 0)} AS INT)" for t, j in ((4, 3), (8, 6), (12, 10), (16, 14), (20, 18))}


@query("finger_poses", with_([HANDS, f"fp AS (SELECT session_id, hand, frame_idx, {_OUT[8]} AS i, {_OUT[12]} AS m, "
       f"{' + '.join(_OUT.values())} AS n FROM hf)"],
       """SELECT session_id, hand, frame_idx, CASE WHEN n = 0 THEN 'Fist' WHEN n = 5 THEN 'Open' WHEN n = 1 THEN
       CASE WHEN i = 1 THEN 'Pointing' ELSE '1_Finger' END WHEN n = 2 THEN CASE WHEN i = 1 AND m = 1 THEN 'Peace'
       ELSE '2_Fingers' END ELSE n || '_Fingers' END AS pose FROM fp"""))
def finger_poses(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.hand_frames(spark, sf).select(
        "session_id", "hand", "frame_idx", lm.finger_count_pose("landmarks").alias("pose")
    )


def _body_sql(source: str) -> str:
    _, left, right = lm.BODY_SOURCES[source]
    side = lambda name, i: (
        f"SELECT session_id, vec_id AS frame_idx, '{source}' AS source, '{name}' AS hand, "
        f"CASE WHEN {pz(i)} >= 0.3 THEN TRUNC({px(i)} * 640.0) END AS x, CASE WHEN {pz(i)} >= 0.3 THEN TRUNC({py(i)} * 480.0) END AS y, "
        f"CASE WHEN {pz(i)} >= 0.3 THEN 1.0::DOUBLE END AS z FROM em"
    )
    return side("left", left) + " UNION ALL " + side("right", right)


@query("body_traces", with_([Q], " UNION ALL ".join(_body_sql(s) for s in lm.BODY_SOURCES)))
def body_traces(spark: SparkSession, sf: str) -> DataFrame:
    frames = fixtures.body_frames(spark, sf)
    parts = [ops.body_trace(frames, W, H, s).withColumn("source", F.lit(s)) for s in lm.BODY_SOURCES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _norm_sql(source: str) -> str:
    if source in lm.NORMALIZED:
        x, y = px(lm.NORMALIZED[source]), py(lm.NORMALIZED[source])
    else:
        x, y = mean((0, 9), px), mean((0, 9), py)
    return f"SELECT session_id, hand, frame_idx, '{source}' AS source, {sr(x, 'x')}, {sr(y, 'y')} FROM hf"


_NORM = ("Whole Hand", "Wrist", "Index", "Thumb", "Median")


@query("normalized_points", with_([HANDS], " UNION ALL ".join(_norm_sql(s) for s in _NORM)))
def normalized_points(spark: SparkSession, sf: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(s).alias("source"), lm.normalized_point("landmarks", s).alias("p")) for s in _NORM])
    out = fixtures.hand_frames(spark, sf).select("session_id", "hand", "frame_idx", F.explode(each).alias("n"))
    return out.select("session_id", "hand", "frame_idx", "n.source", r(F.col("n.p.x"), alias="x"), r(F.col("n.p.y"), alias="y"))


@query("hand_visibility", with_([HANDS], f"""SELECT session_id, hand, frame_idx, {sr('LIST_AVG(q[1:17])', 'visibility')},
       LIST_AVG(q[1:17]) >= 0.5 AS visible FROM hf"""))
def hand_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Mean visibility with the scaled components standing in for per-point scores."""
    first = F.slice("q", 1, 17)
    points = F.transform(first, lambda v: F.struct(v.alias("x"), v.alias("y"), v.alias("z"), v.alias("visibility")))
    frames = fixtures.hand_frames(spark, sf).join(
        fixtures._scaled(spark, sf).select("vec_id", points.alias("points")), "vec_id"
    )
    return frames.select(
        "session_id", "hand", "frame_idx", r(lm.mean_visibility("points"), alias="visibility"),
        lm.hand_visible("points", 0.5).alias("visible"),
    )


_PARTS = ", ".join(f"('{n}', {first}, {count})" for n, (first, count) in lm.WHOLE_BODY_PARTS.items())


@query("wholebody_parts", with_([Q, f"""wb AS (SELECT vec_id, p.part, first, UNNEST(RANGE(n)) AS i, q FROM em,
       (VALUES {_PARTS}) p(part, first, n))"""],
       f"""SELECT CAST(FLOOR(vec_id / 4) AS BIGINT) AS frame_idx, CAST(vec_id % 4 AS INT) AS person_no, part, COUNT(*) AS points,
       {sr('SUM(q[CAST(2*(first+i) % 63 + 1 AS INT)])', 'sum_x')}, {sr('SUM(q[CAST((2*(first+i)+1) % 63 + 1 AS INT)])', 'sum_y')},
       {sr('AVG(q[CAST((first+i) % 64 + 1 AS INT)])', 'visibility')} FROM wb GROUP BY ALL"""))
def wholebody_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = ops.wholebody_split(fixtures.pose_raw(spark, sf), W, H)
    total = lambda c: F.aggregate("keypoints", F.lit(0.0), lambda s, p: s + p[c])
    return parts.select(
        "frame_idx", "person_no", "part", F.size("keypoints").cast("bigint").alias("points"), r(total("x"), alias="sum_x"),
        r(total("y"), alias="sum_y"), r(lm.mean_visibility("keypoints"), alias="visibility"),
    )


@query("top_person", with_([Q], f"""SELECT frame_idx, CAST(person_no AS INT) AS person_no, {sr('bbox_score')} FROM (
       SELECT CAST(FLOOR(vec_id / 4) AS BIGINT) AS frame_idx, vec_id % 4 AS person_no, q[64] AS bbox_score,
       ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(vec_id / 4) AS BIGINT) ORDER BY q[64] DESC, vec_id) AS n FROM em) WHERE n = 1"""))
def top_person(spark: SparkSession, sf: str) -> DataFrame:
    return ops.top_person(fixtures.pose_raw(spark, sf)).select("frame_idx", "person_no", r("bbox_score"))


@query("rotated_points", with_([trace_cte()], f"""SELECT session_id, hand, frame_idx, a.angle, {sr('''CASE a.angle WHEN 90 THEN 480 - y
       WHEN 180 THEN 640 - x WHEN 270 THEN y ELSE x END''', 'x')}, {sr('''CASE a.angle WHEN 90 THEN x WHEN 180 THEN 480 - y
       WHEN 270 THEN 640 - x ELSE y END''', 'y')} FROM trace, (VALUES (0), (90), (180), (270)) a(angle) WHERE x IS NOT NULL"""))
def rotated_points(spark: SparkSession, sf: str) -> DataFrame:
    angles = F.explode(F.array(*[F.lit(a) for a in (0, 90, 180, 270)]))
    turned = fixtures.trace(spark, sf).where(F.col("x").isNotNull()).withColumn("angle", angles)
    p = lm.rotate_point(F.col("x"), F.col("y"), F.col("angle"), W, H)
    return turned.withColumn("p", p).select("session_id", "hand", "frame_idx", "angle", r(F.col("p.x"), alias="x"), r(F.col("p.y"), alias="y"))


# --- gestures ----------------------------------------------------------------------------------------

GESTURES = """ge AS (SELECT user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS hand,
   event_type AS gesture FROM events)"""


@query("gesture_counts", with_([GESTURES], "SELECT session_id, hand, gesture, COUNT(*) AS count FROM ge GROUP BY ALL"))
def gesture_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ops.gesture_counts(fixtures.gestures(spark, sf))


#: Event types of the test table, in place of gesture labels.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("gesture_matrix", with_([GESTURES], "SELECT session_id, " + ", ".join(
       f"COUNT(*) FILTER (hand = '{h}' AND gesture = '{g}') AS {h.capitalize()}_{g}" for h in ("left", "right") for g in EVENT_TYPES) + " FROM ge GROUP BY session_id"))
def gesture_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ops.gesture_matrix(fixtures.gestures(spark, sf), EVENT_TYPES)


@query("gesture_labels", "SELECT DISTINCT event_type AS gesture FROM events ORDER BY 1")
def gesture_labels(spark: SparkSession, sf: str) -> DataFrame:
    return ops.gesture_labels(fixtures.gestures(spark, sf))


# --- grids -------------------------------------------------------------------------------------------

def _box_cte(indices, condition: str = "TRUE") -> str:
    xs = ", ".join(f"CASE WHEN {condition.format(v=pz(i))} THEN CAST(TRUNC({px(i)} * 640.0) AS INT) END" for i in indices)
    ys = ", ".join(f"CASE WHEN {condition.format(v=pz(i))} THEN CAST(TRUNC({py(i)} * 480.0) AS INT) END" for i in indices)
    return f"""bx0 AS (SELECT session_id, GREATEST(0, LEAST({xs})) AS x0, LEAST(640, GREATEST({xs})) AS x1,
   GREATEST(0, LEAST({ys})) AS y0, LEAST(480, GREATEST({ys})) AS y1 FROM em),
bx AS (SELECT session_id, x0, CASE WHEN x1 = x0 THEN x1 + 1 ELSE x1 END AS x1, y0,
   CASE WHEN y1 = y0 THEN y1 + 1 ELSE y1 END AS y1 FROM bx0),
heat0 AS (SELECT session_id, x0, x1, UNNEST(RANGE(y0, y1)) AS y FROM bx),
heat1 AS (SELECT session_id, y, UNNEST(RANGE(x0, x1)) AS x FROM heat0),
heat AS (SELECT session_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(COUNT(*) AS DOUBLE) AS v FROM heat1
   WHERE x < 640 AND y < 480 GROUP BY ALL)"""


HEAT = _box_cte(range(21))
CELL = "session_id, x, y"

SPEED_HEAT = """sb0 AS (SELECT *, SQRT(POWER(x - LAG(x) OVER p, 2) + POWER(y - LAG(y) OVER p, 2)) AS w FROM filtered
   WINDOW p AS (PARTITION BY session_id, hand ORDER BY frame_idx)),
sb AS (SELECT session_id, CAST(x AS INT) AS px, CAST(y AS INT) AS py, w FROM sb0 WHERE w > 0 AND x BETWEEN 0 AND 639 AND y BETWEEN 0 AND 479),
sc AS (SELECT session_id, px, w, UNNEST(RANGE(GREATEST(0, py-5), LEAST(480, py+5))) AS y FROM sb),
sd AS (SELECT session_id, w, y, UNNEST(RANGE(GREATEST(0, px-5), LEAST(640, px+5))) AS x FROM sc),
heat AS (SELECT session_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, SUM(w) AS v FROM sd GROUP BY ALL)"""

SHARE = "shared AS (SELECT *, v / MAX(v) OVER (PARTITION BY session_id) AS share FROM heat)"


def heat(spark: SparkSession, sf: str) -> DataFrame:
    return grids.occupancy(ops.hand_boxes(fixtures.hand_frames(spark, sf), W, H), W, H)


@query("occupancy_heatmap", with_([Q, HEAT], f"SELECT {CELL}, {sr('v', digits=3)} FROM heat"))
def occupancy_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return heat(spark, sf).select("session_id", "x", "y", r("v", 3))


@query("index_finger_heatmap", with_([Q, _box_cte(lm.HAND_SOURCES["Index"])], f"SELECT {CELL}, {sr('v', digits=3)} FROM heat"))
def index_finger_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    boxes = ops.hand_boxes(fixtures.hand_frames(spark, sf), W, H, "Index")
    return grids.occupancy(boxes, W, H).select("session_id", "x", "y", r("v", 3))


@query("body_heatmap", with_([Q, _box_cte(lm.BODY_SOURCES["Arms"][0], "{v} >= 0.3")], f"SELECT {CELL}, {sr('v', digits=3)} FROM heat"))
def body_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    boxes = ops.body_boxes(fixtures.body_frames(spark, sf), W, H, "Arms")
    return grids.occupancy(boxes, W, H).select("session_id", "x", "y", r("v", 3))


@query("speed_heatmap", with_([trace_cte(), FILTERED_CTE, SPEED_HEAT], f"SELECT {CELL}, {sr('v', digits=3)} FROM heat"))
def speed_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return grids.speed_heatmap(filtered(spark, sf), W, H).select("session_id", "x", "y", r("v", 3))


@query("heat_threshold", with_([Q, HEAT, SHARE], f"SELECT {CELL}, {sr('share', digits=5)} FROM shared WHERE share > 0.5"))
def heat_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return grids.heat_threshold(heat(spark, sf), 0.5).select("session_id", "x", "y", r("share", 5))


@query("voxel_density", with_([Q, HEAT, SHARE, "b AS (SELECT UNNEST(RANGE(50)) AS i)",
       "bx_ AS (SELECT i, CAST(TRUNC(i * (639.0::DOUBLE / 49.0)) AS INT) AS p FROM b)",
       "by_ AS (SELECT i, CAST(TRUNC(i * (479.0::DOUBLE / 49.0)) AS INT) AS p FROM b)"],
       f"""SELECT session_id, CAST(bx_.i AS INT) AS bin_x, CAST(by_.i AS INT) AS bin_y,
       CAST(UNNEST(RANGE(CAST(TRUNC(share * 19) AS INT) + 1)) AS INT) AS level, {sr('share', digits=5)} FROM shared
       JOIN bx_ ON x = bx_.p JOIN by_ ON y = by_.p WHERE share > 0.02"""))
def voxel_density(spark: SparkSession, sf: str) -> DataFrame:
    out = grids.voxel_density(heat(spark, sf), W, H)
    return out.select("session_id", "bin_x", "bin_y", "level", r("share", 5))


_TAPS = """taps AS (SELECT k, EXP(-(k*k) / 128.0) / (SELECT SUM(EXP(-(j*j) / 128.0)) FROM (SELECT UNNEST(RANGE(-25, 26)) AS j)) AS g
   FROM (SELECT UNNEST(RANGE(-25, 26)) AS k))"""


def _pass(source: str, out: str, axis: str, other: str, size: int) -> str:
    return f"""{out}m AS (SELECT session_id, {other}, {axis} AS s, v FROM {source} UNION ALL
   SELECT session_id, {other}, -{axis}, v FROM {source} WHERE {axis} > 0 UNION ALL
   SELECT session_id, {other}, {2 * size - 2} - {axis}, v FROM {source} WHERE {axis} < {size - 1}),
{out} AS (SELECT session_id, {other}, CAST(s - k AS INT) AS {axis}, SUM(v * g) AS v FROM {out}m, taps
   WHERE s - k BETWEEN 0 AND {size - 1} GROUP BY ALL)"""


@query("blurred_heatmap", with_([Q, HEAT, _TAPS, _pass("heat", "bh", "x", "y", 640), _pass("bh", "bv", "y", "x", 480)],
       f"SELECT {CELL}, {sr('v', digits=3)} FROM bv"))
def blurred_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return grids.gaussian_blur(heat(spark, sf), W, H).select("session_id", "x", "y", r("v", 3))


@query("spatial_density", with_([HANDS], f"""SELECT CAST(FLOOR({mean((0, 9), px)} * 20) AS INT) AS bin_x,
       CAST(FLOOR((1.0 - {mean((0, 9), py)}) * 20) AS INT) AS bin_y, COUNT(*) AS count FROM hf GROUP BY ALL"""))
def spatial_density(spark: SparkSession, sf: str) -> DataFrame:
    return grids.spatial_density(fixtures.hand_frames(spark, sf))
