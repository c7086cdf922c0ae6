"""Hand-computed edge rows and independent numpy loops."""

from __future__ import annotations

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinescribe.functions import landmarks as lm
from kinescribe.functions import scalars
from kinescribe.operators import episodes, grids, lookups, topics, traces
from kinescribe.operators import landmarks as ops
from kinescribe.operators import transcript as tr
from kinescribe.sources import library, sessions
from tests_util import TRACE, trace_of


def points(df):
    return [None if r.x is None else r.x for r in df.orderBy("frame_idx").collect()]


def test_filter_trace_limits(spark):
    # 80 pixels is exactly 10 % of the diagonal and no jump; 81 is one. Segments of 5 stay, of 4 go.
    keep = traces.filter_trace(trace_of(spark, [0, 80, 160, 240, 320]), 640, 480)
    assert points(keep) == [0, 80, 160, 240, 320]
    cut = traces.filter_trace(trace_of(spark, [0, 1, 2, 3, 84, 85, 86, 87, 88, None, 5]), 640, 480)
    assert points(cut) == [None] * 4 + [84, 85, 86, 87, 88, None, None]


def test_empty_and_unseen_traces(spark):
    empty = spark.createDataFrame([], TRACE)
    assert traces.filter_trace(empty, 640, 480).count() == 0
    unseen = trace_of(spark, [None] * 6)
    assert points(traces.filter_trace(unseen, 640, 480)) == [None] * 6
    assert traces.derivatives(unseen, 30.0).count() == 0
    assert {r.phase for r in traces.phase_label(unseen, traces.phases(traces.derivatives(unseen, 30.0))).collect()} == {-1}
    assert episodes.segment_episodes(unseen).count() == 0


def test_four_points_have_no_derivatives_but_five_do(spark):
    assert traces.derivatives(trace_of(spark, [1, 2, None, 3, 4]), 30.0).count() == 0
    assert traces.derivatives(trace_of(spark, [1, 2, None, 3, 4, 5]), 30.0).count() == 5


def test_still_hand_hovers(spark):
    phased = traces.phases(traces.derivatives(trace_of(spark, [7] * 8), 30.0))
    assert {r.phase for r in phased.collect()} == {traces.HOVER}
    assert traces.hmi_metrics(phased).first().tortuosity == 1.0


def test_smoothing_starts_above_five_speeds(spark):
    xs = [0, 3, 9, 1, 12, 5]
    five = episodes.velocities(trace_of(spark, xs)).orderBy("frame_idx").collect()
    assert [r.smooth for r in five] == [r.velocity for r in five]
    xs += [14]
    got = episodes.velocities(trace_of(spark, xs)).orderBy("frame_idx").collect()
    v = np.array([r.velocity for r in got])
    fits = [np.polyval(np.polyfit(range(5), v[s : s + 5], 2), at) for s, at in ((0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (1, 4))]
    assert np.allclose([r.smooth for r in got], fits)


def test_episode_length_and_gap_limits(spark):
    # Active speeds 0-3 and 6-9 at one frame a second.
    xs = [0, 9, 18, 27, 36, 36, 36, 45, 54, 63, 72]
    trace = trace_of(spark, xs, fps=1.0)
    args = {"velocity_threshold": 1.0, "smooth": False}
    assert episodes.segment_episodes(trace, min_duration=3.0, **args).count() == 2
    assert episodes.segment_episodes(trace, min_duration=3.01, **args).count() == 0
    assert episodes.find_episodes(trace, min_duration=1.0, merge_gap=3.0, **args).count() == 1
    assert episodes.find_episodes(trace, min_duration=1.0, merge_gap=2.9, **args).count() == 2


def test_speech_alignment_limits(spark):
    eps = spark.createDataFrame([("s", "left", 0, 100, 10.0, 20.0)], "session_id string, hand string, start_frame bigint, end_frame bigint, start_time double, end_time double")
    speech = [(1, 18.0, 28.0), (2, 17.5, 27.5), (3, 20.0, 25.0), (4, 15.0, 15.0), (5, 0.0, 100.0), (6, 12.0, 13.0)]
    said = spark.createDataFrame([("s", n, a, b, "t") for n, a, b in speech], "session_id string, seg_idx int, start_s double, end_s double, text string")
    # 1 overlaps by exactly 0.2, 3 touches, 4 has no length, 5 overlaps by 0.1.
    pairs = lookups.align_speech(eps, said, seconds=4.0)
    assert sorted(r.seg_idx for r in pairs.collect()) == [2, 6]
    row = lookups.aligned_speech(eps, pairs).first()
    assert [s.start_s for s in row.aligned_speech] == [17.5, 12.0] or [s.start_s for s in row.aligned_speech] == [12.0, 17.5]


def test_lookup_bounds(spark):
    said = spark.createDataFrame([("s", 0, 0.0, 5.0, "a"), ("s", 1, 5.0, 9.0, "b")], "session_id string, seg_idx int, start_s double, end_s double, text string")
    times = spark.createDataFrame([("s", 5.0), ("s", 9.0), ("s", 10.0)], "session_id string, time_s double")
    got = {r.time_s: r.found and r.found.text for r in lookups.sentence_at(times, said).collect()}
    assert got == {5.0: "a", 9.0: "b", 10.0: None}
    shown = spark.createDataFrame([("s", "left", 50, "Victory")], "session_id string, hand string, frame_idx bigint, gesture string")
    ctx = {r.time_s: (r.gesture_left, r.gesture_right, r.spoken) for r in lookups.context_at(times, shown, said, 10.0).collect()}
    assert ctx == {5.0: ("Victory", "None", "b"), 9.0: ("None", "None", ""), 10.0: ("None", "None", "")}


def test_last_hand_of_a_frame_wins(spark):
    rows = [("s", 0, 0, "Left", 1.0), ("s", 0, 1, "Left", 2.0), ("s", 0, 2, "Unknown", 3.0)]
    pts = spark.createDataFrame(rows, "session_id string, frame_idx bigint, hand_no int, hand string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(1.0)})
    assert {(r.hand, r.x) for r in ops.hand_pivot(pts).collect()} == {("left", 2.0), ("right", 3.0)}


def test_boxes_off_the_frame(spark):
    # x0, x1, y0, y1 of two points each, in a frame of 10 x 10 pixels.
    spans = {"left": (-5, -2, 1, 3), "right": (12, 15, 1, 3), "over": (-3, 4, 8, 20), "flat": (4, 4, 5, 5), "edge": (10, 10, 1, 3)}
    rows = [(k, [(a / 10, c / 10), (b / 10, d / 10)]) for k, (a, b, c, d) in spans.items()]
    pts = spark.createDataFrame(rows, "session_id string, points array<struct<x: double, y: double>>")
    got = {r.session_id: (r.x0, r.x1, r.y0, r.y1) for r in ops.boxes_of(pts, 10, 10).collect()}
    assert got == {"over": (0, 4, 8, 10), "flat": (4, 5, 5, 6)}


def test_density_equals_loop(spark):
    rng = np.random.default_rng(0)
    want, rows = np.zeros((30, 40)), []
    for _ in range(60):
        x0, x1 = sorted(rng.integers(0, 41, 2)); y0, y1 = sorted(rng.integers(0, 31, 2))  # noqa: E702
        if x0 < x1 and y0 < y1:
            w = float(rng.random())
            want[y0:y1, x0:x1] += w
            rows.append(("s", int(x0), int(x1), int(y0), int(y1), w))
    boxes = spark.createDataFrame(rows, "session_id string, x0 int, x1 int, y0 int, y1 int, w double")
    got = np.zeros_like(want)
    for r in grids.box_density(boxes, 40, 30).collect():
        got[r.y, r.x] += r.v
    assert np.allclose(got, want)


def test_blur_keeps_mass_and_mirrors(spark):
    grid = spark.createDataFrame([("s", 1, 2, 1.0)], "session_id string, x int, y int, v double")
    got = {(r.x, r.y): r.v for r in grids.gaussian_blur(grid, 20, 20, 5).collect()}
    k = grids.blur_kernel(5)
    assert got[(1, 2)] == pytest.approx((k[2] + k[0]) * k[2])  # its mirror image lies at x = -1
    assert got[(3, 2)] == pytest.approx(k[0] * k[2])


def test_sparc_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 700
    xs = np.cumsum(rng.random(n))
    trace = trace_of(spark, [float(x) for x in xs], fps=10.0)
    eps = spark.createDataFrame([("s", "left", 0, n - 1, 0.0, (n - 1) / 10)], "session_id string, hand string, start_frame bigint, end_frame bigint, start_time double, end_time double")
    motion = episodes.episode_motion(episodes.episode_points(trace, eps, rows=100), rows=100)
    v = np.diff(xs) * 10.0
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    parts = []
    for s in range(0, len(v) - 255, 128):
        seg = v[s : s + 256] - v[s : s + 256].mean()
        p = np.abs(np.fft.rfft(seg * hann)) ** 2
        p[1:-1] *= 2
        parts.append(p)
    p = np.mean(parts, axis=0)
    p /= p.sum()
    want = np.sum(np.hypot(10.0 / 256, np.diff(p)))
    assert episodes.sparc(motion).first().smoothness_sparc == pytest.approx(want, rel=1e-6)


def test_gesture_rules(spark):
    def hand(up=(), thumb=0.0):
        pts = [(0.5, 1.0)] * 21
        for name, (tip, pip, mcp) in lm.FINGERS.items():
            pts[mcp], pts[pip] = (0.5, 0.7), (0.5, 0.6)
            pts[tip] = (0.5, 0.4) if name in up else (0.5, 0.8)
        pts[2], pts[4] = (0.5, 0.8), (0.5, 0.8 - thumb)
        return [(float(x), float(y), 0.0, 1.0) for x, y in pts]

    cases = {
        "Closed_Fist": hand(), "Open_Palm": hand(lm.FINGERS), "Pointing_Up": hand(["index"]), "Victory": hand(["index", "middle"]),
        "ILoveYou": hand(["index", "pinky"], 0.1), "Thumb_Up": hand((), 0.1), "Thumb_Down": hand((), -0.1), None: hand(["ring"]),
    }
    schema = "want string, landmarks array<struct<x: double, y: double, z: double, visibility: double>>"
    df = spark.createDataFrame([*cases.items(), ("short", [(0.0, 0.0, 0.0, 1.0)])], schema)
    got = {r.want: r.g and r.g.gesture for r in df.select("want", lm.gesture_classify("landmarks").alias("g")).collect()}
    assert got.pop("short") is None
    assert all(k == v for k, v in got.items())


def test_label_fold(spark):
    words = ["cars", "trucks", "truck", "red", "also", "new roads", "wheel"]
    df = spark.createDataFrame([(0, i + 1, w, 1.0) for i, w in enumerate(words)] + [(1, 1, "red", 1.0)], "topic int, rank int, term string, weight double")
    got = {r.topic: r.label for r in topics.keyword_labels(df).collect()}
    assert got == {0: "Trucks New roads Wheel", 1: "Topic 2"}


def test_scalars(spark):
    df = spark.createDataFrame([(45.0,), (134.0,), (3780.0,)], "s double")
    assert [r[0] for r in df.select(scalars.format_duration(F.col("s"))).collect()] == ["45s", "2m 14s", "1h 3m"]
    row = spark.range(1).select(
        scalars.cosine_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        scalars.beautify_label(F.lit("new_car_is_BIG_thing")).alias("label"),
        scalars.day_label(F.lit(datetime.date(2024, 5, 2)), F.lit(datetime.date(2024, 5, 3))).alias("day"),
    ).first()
    assert (row.zero, row.label, row.day) == (0.0, "New Car Big", "Yesterday (May 02)")


def test_noise_needs_short_text(spark):
    df = spark.createDataFrame([("now",), ("okay then",), ("nothing to see here",), ("map",)], "text string")
    assert [r.text for r in tr.noise_filter(df).collect()] == ["nothing to see here", "map"]


def test_chunks_of_transcript(spark):
    rows = [("s", 0, 290.0, 300.5, "Over the border."), ("s", 1, 0.0, 2.5, "over the border"), ("s", 1, 3.0, 5.0, "later"), ("s", 0, 301.0, 302.0, "not mine")]
    df = spark.createDataFrame(rows, "session_id string, chunk_idx int, start_s double, end_s double, text string")
    got = sorted((r.chunk_idx, r.start_s, r.text) for r in tr.stitch_chunks(df).collect())
    assert got == [(0, 290.0, "Over the border."), (1, 301.0, "later")]


def test_library_and_sessions(spark, tmp_path):
    for i, name in enumerate(["Talk_Analysis_20240501.bin", "Analysis_my_talk_2024_0501.bin", "other.bin"]):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (1_714_600_000 + i * 86_400,) * 2)
    listed = library.list_library(spark, str(tmp_path), F.lit(datetime.date(2024, 5, 3))).collect()
    assert [r.display_name for r in listed] == ["other.bin", "my_talk", "Talk"]
    assert [r.day_label for r in listed] == ["Today (May 03)", "Yesterday (May 02)", "May 01, 2024"]
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "c.json").write_text('{"A": ["x", "y"],\n "B": []}')
    assert {r.category: r.terms for r in library.read_lexicon(spark, str(tmp_path / "lex" / "c.json")).collect()} == {"A": ["x", "y"], "B": []}

    root = str(tmp_path / "store")
    ids = spark.createDataFrame([("a",), ("b",)], "session_id string")
    said = spark.createDataFrame([("a", 0, "hi"), ("b", 0, "ho")], "session_id string, seg_idx int, text string")
    with pytest.raises(sessions.EmptySessionError):
        sessions.write_session({"sessions": ids, "transcript": said.limit(0)}, root)
    sessions.write_session({"sessions": ids, "transcript": said}, root)
    sessions.write_session({"transcript": said.where("session_id = 'a'").withColumn("text", F.lit("new"))}, root)
    saved = sessions.read_sessions(spark, root, ["a"])
    assert [r.text for r in saved["transcript"].collect()] == ["new"]
    assert saved["sessions"].first().fps == 30.0 and saved["trace"].count() == 0
    assert sessions.read_sessions(spark, root)["transcript"].count() == 2


def test_upgrades(spark):
    persons = spark.createDataFrame([("s", 0, 1, "body")], "session_id string, frame_idx bigint, person_no int, part string")
    single = spark.createDataFrame([("s", 0, "body"), ("s", 1, "body")], "session_id string, frame_idx bigint, part string")
    got = sorted((r.frame_idx, r.person_no) for r in sessions.upgrade_bodies(persons, single).collect())
    assert got == [(0, 1), (1, 0)]
