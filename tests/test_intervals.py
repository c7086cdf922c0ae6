"""Interval joins and lookups with intervals of very different lengths."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinescribe.operators import lookups


def spans(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.choice([rng.uniform(-500, 100_000), float(rng.randrange(0, 90_000, 60))])
        out.append((rng.choice("ab"), i, start, start + rng.choice([-1.0, 0.0, 0.5, 7.0, 60.0, 600.0, 86_400.0, rng.uniform(0, 3e6)])))
    return out


def test_pairs_of_all_lengths(spark):
    left, right = spans(1, 150), spans(2, 150)
    a, b = (spark.createDataFrame(rows, f"s string, {n} int, {n}s double, {n}e double") for rows, n in ((left, "l"), (right, "r")))
    got = sorted((r.l, r.r) for r in lookups.overlapping(a, b, ["s"], ("ls", "le"), ("rs", "re")).collect())
    ok = lambda x: x[2] <= x[3]
    assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and ok(x) and ok(y) and x[2] <= y[3] and y[2] <= x[3])


def test_few_copies_of_a_long_interval(spark):
    rows = spark.createDataFrame([(0.0, 86_400.0), (3.0, 4.0), (59.0, 61.0)], "s double, e double")
    alone = {r.s: r["count"] for r in lookups.by_cell(rows, "s", "e").groupBy("s").count().collect()}
    assert alone[0.0] <= 2 and alone[3.0] == 1 and alone[59.0] == 2
    every = F.array(*[F.lit(i) for i in range(30)])
    assert lookups.by_cell(rows, "s", "e", 60.0, every).groupBy("s").count().agg(F.max("count")).first()[0] < 50


def test_first_interval_at_a_time(spark):
    rows = spans(4, 120)
    rng = random.Random(5)
    times = [(rng.choice("abc"), rng.choice([None, rng.uniform(-600, 120_000), rows[i % 120][2], rows[i % 120][3]])) for i in range(200)]
    asked = spark.createDataFrame(times, "s string, time_s double")
    found = lookups.first_covering(asked, spark.createDataFrame(rows, "s string, n int, x double, y double"), ["s"], ("x", "y"), "n")
    got = sorted(((r.s, r.time_s, r.found and r.found.n) for r in found.collect()), key=str)
    first = lambda s, t: min((n for k, n, x, y in rows if k == s and t is not None and x <= t <= y), default=None)
    assert got == sorted(((s, t, first(s, t)) for s, t in times), key=str)
    none = lookups.first_covering(asked, spark.createDataFrame([], "s string, n int, x double, y double"), ["s"], ("x", "y"), "n")
    assert none.count() == 200 and none.where("found IS NOT NULL").count() == 0


def test_first_episodes_with_speech(spark):
    rng = random.Random(6)
    episodes = [(s, h, f, float(f // 2), float(f // 2) + 5.0) for s in "ab" for h in ("left", "right") for f in range(0, 300, 10)]
    episodes = [e for e in episodes if rng.random() < 0.8] + [("c", "left", 0, 0.0, 5.0)]
    speech = [(s, i, float(4 * i), float(4 * i) + rng.choice([0.0, 2.0, 9.0]), f"{s}{i}") for s in "ab" for i in range(40) if rng.random() < 0.6]
    found = spark.createDataFrame(episodes, "session_id string, hand string, start_frame long, start_time double, end_time double")
    said = spark.createDataFrame(speech, "session_id string, seg_idx int, start_s double, end_s double, text string")
    for n in (1, 7, 20):
        want = []
        for s in "ab":
            told = []
            for e in sorted((e for e in episodes if e[0] == s), key=lambda e: (e[3], e[1], e[2])):
                texts = [x[4] for x in speech if x[0] == s and x[3] > x[2] and min(x[3], e[4]) - max(x[2], e[3]) > 0.2 * (x[3] - x[2])]
                told += [(s, e[1], e[2], texts)] * bool(texts)
            want += [(*e, lane) for lane, e in enumerate(told[:n])]
        got = lookups.spoken_episodes(found, lookups.align_speech(found, said), n).collect()
        assert sorted((r.session_id, r.hand, r.start_frame, [x.text for x in r.aligned_speech], r.lane) for r in got) == sorted(want)
    none = lookups.spoken_episodes(found, lookups.align_speech(found, said.limit(0)))
    assert none.count() == 0 and none.columns == [*found.columns, "lane", "aligned_speech"]
