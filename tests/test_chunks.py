"""Chunked plans must give the same rows whatever the chunk length."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinescribe.operators import contacts, episodes, traces
from kinescribe.operators import transcript as tr
from kinescribe.plans.chunks import dense_index, running_sum

DIM = {"width": 640, "height": 480}
TRACE_SCHEMA = "session_id string, hand string, frame_idx bigint, ts double, x double, y double, z double"


def random_trace(seed: int, frames: int = 160) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows, x, y = [], 300.0, 200.0
    for hand in ("left", "right"):
        for i in range(frames):
            if rng.random() < 0.3:
                x, y = x + rng.normal(0, 30), y + rng.normal(0, 30)
            seen = rng.random() > 0.08
            point = (float(int(x)), float(int(y)), 1.0 + rng.random()) if seen else (None, None, None)
            rows.append(("s", hand, i, i / 30.0, *point))
    return rows


@pytest.fixture(scope="module")
def trace(spark):
    return spark.createDataFrame(random_trace(1), TRACE_SCHEMA).cache()


def rows_of(df, digits=6):
    out = []
    for row in df.collect():
        out.append(tuple(round(v, digits) if isinstance(v, float) else v for v in row.asDict().values()))
    return sorted(out, key=repr)


def same(a, b, digits=6):
    left, right = rows_of(a, digits), rows_of(b, digits)
    assert left and left == right


def test_filter_trace(trace):
    same(traces.filter_trace(trace, **DIM, rows=9), traces.filter_trace(trace, **DIM))


def test_speeds(trace):
    same(traces.speeds(trace, **DIM, rows=11), traces.speeds(trace, **DIM))


def test_phases_and_runs(trace):
    small = traces.phases(traces.derivatives(trace, 30.0, rows=7))
    large = traces.phases(traces.derivatives(trace, 30.0))
    pick = ["hand", "frame_idx", "n", "speed", "accel", "jerk", "phase", "prev_phase", "next_phase"]
    same(small.select(pick), large.select(pick), 4)
    same(traces.reach_runs(small, rows=7), traces.reach_runs(large))
    same(traces.phase_runs(traces.phase_label(trace, small), 30.0, rows=7), traces.phase_runs(traces.phase_label(trace, large), 30.0))
    same(traces.presence_runs(trace, 30.0, rows=5), traces.presence_runs(trace, 30.0))


@pytest.mark.parametrize("smooth", [True, False])
def test_episodes(trace, smooth):
    args = {"velocity_threshold": 200.0, "min_duration": 0.05, "merge_gap": 0.1, "smooth": smooth}
    same(episodes.find_episodes(trace, **args, rows=8), episodes.find_episodes(trace, **args))


def test_merge_across_time_buckets(spark):
    rows = [("s", "left", i * 10, i * 10 + 8, i * 1.0, i * 1.0 + 0.8) for i in range(40)]
    eps = spark.createDataFrame(rows, "session_id string, hand string, start_frame bigint, end_frame bigint, start_time double, end_time double")
    out = episodes.merge_episodes(eps, 0.25, bucket_s=3.0, rows=16).collect()
    assert [(r.start_frame, r.end_frame) for r in out] == [(0, 398)]
    assert episodes.merge_episodes(eps, 0.1, bucket_s=3.0, rows=16).count() == 40


def test_episode_features(trace):
    args = {"velocity_threshold": 60.0, "min_duration": 0.1, "merge_gap": 0.2}
    found = episodes.find_episodes(trace, **args)
    small = episodes.episode_motion(episodes.episode_points(trace, found, rows=6), rows=6)
    large = episodes.episode_motion(episodes.episode_points(trace, found))
    cols = [*episodes.EPISODE, *episodes.KINEMATIC, *episodes.INTENT, "episode_type"]
    same(episodes.episode_features(found, small).select(cols), episodes.episode_features(found, large).select(cols), 4)


def test_contacts(spark):
    rng = np.random.default_rng(3)
    walk = np.abs(np.cumsum(rng.normal(0, 4, 300))) % 40
    rows = [("s", 0, "hand", 1, "cup", i, float(d)) for i, d in enumerate(walk)]
    df = spark.createDataFrame(rows, "session_id string, person_id int, body_part string, object_id int, object_label string, frame_idx bigint, distance_px double")
    same(contacts.contact_events(df, 10, 20, 3, 10.0, rows=7), contacts.contact_events(df, 10, 20, 3, 10.0))
    state, expected, run_near, run_far = 0, 0, 0, 0
    for d in walk:
        run_near, run_far = (run_near + 1 if d < 10 else 0), (run_far + 1 if d > 20 else 0)
        if state == 0 and run_near >= 3:
            state, expected = 1, expected + 1
        elif state == 1 and run_far >= 3:
            state = 0
    assert contacts.contact_events(df, 10, 20, 3, 10.0, rows=7).count() == expected > 1


def test_dense_index_and_running_sum(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    out = running_sum(dense_index(df, ["k"], F.floor(F.col("t") / 17), ["t"], "n", "c"), ["k"], F.floor(F.col("t") / 13), ["t"], F.col("t"), "s")
    for row in out.collect():
        assert row.n == row.t // 3 and row.c == math.ceil((500 - row.k) / 3)
        assert row.s == sum(range(row.k, row.t, 3))


def plain_sentences(words):
    out, current = [], []
    for i, (w, start, end) in enumerate(words):
        if w.strip():
            current.append((w.strip(), start, end))
            size = sum(len(c[0]) + 1 for c in current)
            gap = i + 1 < len(words) and words[i + 1][1] - end > 1.0
            if w.strip()[-1] in ".!?" or (gap and size > 30) or size > 250:
                out.append(current)
                current = []
    if current:
        out.append(current)
    return sorted(" ".join(w for w, _, _ in s) for s in out)


@pytest.mark.parametrize("stops", [0.0, 0.02])
def test_sentences_across_chunks(spark, stops):
    rng, t, words = np.random.default_rng(7), 0.0, []
    for _ in range(3000):
        word = "x" * int(rng.integers(1, 9)) + ("." if rng.random() < stops else "")
        word = "  " if rng.random() < 0.03 else word
        t += 2.0 if rng.random() < 0.02 else 0.1
        words.append((word, round(t, 3), round(t + 0.05, 3)))
    df = spark.createDataFrame([("s", i, *w) for i, w in enumerate(words)], "session_id string, i bigint, word string, start_s double, end_s double")
    got = tr.words_to_sentences(df, ["i"], F.floor(F.col("i") / 100), rows=400)
    assert sorted(r.text for r in got.collect()) == plain_sentences(words)


def test_null_keys_and_null_order_are_kept(spark):
    rows = [("a", 1, 1.0), ("a", None, 2.0), (None, 5, 3.0), (None, 5, 4.0), (None, None, 5.0), ("a", 1, 6.0)]
    df = spark.createDataFrame(rows, "k string, t bigint, v double")
    ranked = dense_index(df, ["k"], F.floor(F.col("t") / 2), ["t", "v"], "n", "size").collect()
    assert sorted((r.k or "", r.n, r.size) for r in ranked) == [("", 0, 3), ("", 1, 3), ("", 2, 3), ("a", 0, 3), ("a", 1, 3), ("a", 2, 3)]
    assert {(r.k, r.v): r.n for r in ranked}[(None, 5.0)] == 0
    summed = running_sum(df, ["k"], F.floor(F.col("t") / 2), ["t", "v"], F.col("v"), "before").collect()
    assert {r.v: r.before for r in summed} == {2.0: 0.0, 1.0: 2.0, 6.0: 3.0, 5.0: 0.0, 3.0: 5.0, 4.0: 8.0}
