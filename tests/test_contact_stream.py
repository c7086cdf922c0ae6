"""The stateful stream of contacts against the batch operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinescribe.operators import contacts as batch
from kinescribe.streaming import contacts

ROWS = "session_id string, person_id int, body_part string, object_id int, object_label string, frame_idx bigint, distance_px double, arrived timestamp"


def frames(seed, n):
    rng = random.Random(seed)
    out, value = [], 20.0
    for i in range(n):
        value = min(40.0, max(0.0, value + rng.choice([-9, -4, 0, 4, 9])))
        out.append((i, value))
    return out


def write(spark, folder, rows, minute):
    at = F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute))
    rows = [(s, 0, p, 0, "cup", f, d, None) for s, p, f, d in rows]
    spark.createDataFrame(rows, ROWS).withColumn("arrived", at).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, base, delay=10):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
    return contacts.run_contacts(contacts.contact_stream(stream, 15.0, 25.0, 2, delay, idle="30 minutes"), 10.0, base)


def rows_of(df):
    return sorted((r.session_id, r.body_part, r.t_start, r.t_end, round(r.mean_distance_px, 6), r.frames) for r in df.collect())


def test_out_of_order_files_and_a_restart(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(2)
    all_rows = [(s, p, f, d) for s in ("a", "b") for p in ("left", "right") for f, d in frames(f"{s}{p}", 60)]
    parts = [[r for r in all_rows if 15 * k <= r[2] + (5 if r[2] % 4 else 0) < 15 * (k + 1)] for k in range(5)]
    assert sum(map(len, parts)) == len(all_rows)
    for k in (0, 1):
        rng.shuffle(parts[k])
        write(spark, folder, parts[k], k)
    first, late = run(spark, folder, base)
    early = rows_of(first)
    assert late.count() == 0
    for k in (2, 3, 4):
        write(spark, folder, parts[k], k)
    # Frames from the first file once more: far too late.
    write(spark, folder, [("a", "left", 1, 3.0), ("a", "left", 2, 3.0)], 5)
    write(spark, folder, [(None, None, None, None)], 600)
    found, late = run(spark, folder, base)
    given = spark.createDataFrame([(s, 0, p, 0, "cup", f, d, None) for s, p, f, d in all_rows], ROWS).drop("arrived")
    want = rows_of(batch.contact_events(given, 15.0, 25.0, 2, 10.0))
    assert rows_of(found) == want and set(early) < set(want)
    assert sorted((r.session_id, r.frame_idx) for r in late.collect()) == [("a", 1), ("a", 2)]
    # Nothing is left in the state.
    state = spark.read.format("statestore").load(f"{base}/state")
    assert state.count() == 0


def test_files_of_one_arrival_time_over_several_batches(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(s, "left", f, d) for s in ("a", "b", "c") for f, d in frames(s, 40)]
    for s in ("a", "b", "c"):
        write(spark, folder, [r for r in rows if r[0] == s], 0)
    write(spark, folder, [(None, None, None, None)], 600)
    found, late = run(spark, folder, base)
    given = spark.createDataFrame([(s, 0, p, 0, "cup", f, d, None) for s, p, f, d in rows], ROWS).drop("arrived")
    assert rows_of(found) == rows_of(batch.contact_events(given, 15.0, 25.0, 2, 10.0))
    assert late.count() == 0


def test_state_does_not_grow_with_the_recording():
    machine = contacts._Machine(contacts._START, 15.0, 25.0, 3)
    import pandas as pd

    sizes = []
    for at in range(0, 20_000, 500):
        got = frames(at, 500)
        machine.add(pd.DataFrame({"frame_idx": [at + f for f, _ in got], "distance_px": [d for _, d in got], "object_label": "cup"}))
        machine.use(machine.newest - 20)
        machine = contacts._Machine(machine.saved(), 15.0, 25.0, 3)
        sizes.append(len(machine.waiting) + len(machine.near))
    assert max(sizes) <= 25


@pytest.mark.parametrize("frames_needed", [1, 2, 4])
@pytest.mark.parametrize("cut", [1, 3, 50])
def test_rule_does_not_depend_on_the_cuts(frames_needed, cut):
    import pandas as pd

    def contacts_of(step):
        machine, found, given = contacts._Machine(contacts._START, 15.0, 25.0, frames_needed), [], frames(9, 200)
        for a in range(0, 200, step):
            part = given[a : a + step]
            machine.add(pd.DataFrame({"frame_idx": [f for f, _ in part], "distance_px": [d for _, d in part], "object_label": "x"}))
            found += machine.use(machine.newest)
            machine = contacts._Machine(machine.saved(), 15.0, 25.0, frames_needed)
        return [(k, a, b, round(t, 6), n) for k, _, a, b, t, n in found + machine.use(None) + machine.close()]

    assert contacts_of(cut) == contacts_of(200)


def test_many_keys_share_a_state(spark, tmp_path):
    # More keys than shards, some of them with a null part: far fewer states than keys, and the rows of the batch operator.
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    one = list(enumerate([3.0] * 4 + [30.0] * 3 + [3.0] * 5))
    rows = [(f"s{k}" if k % 7 else f'"{k}\\', k % 3 or None, ("left", None)[k % 5 == 0], 0, "cup", f, d) for k in range(3 * contacts.SHARDS) for f, d in one]
    given = spark.createDataFrame(rows, ROWS.rsplit(",", 1)[0])
    for minute, part in enumerate(("frame_idx < 6", "frame_idx >= 6")):
        given.where(part).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute))).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, base, delay=2)
    assert 0 < spark.read.format("statestore").load(f"{base}/state").count() <= contacts.SHARDS
    write(spark, folder, [(None, None, None, None)], 600)
    found, late = run(spark, folder, base, delay=2)
    want = batch.contact_events(given, 15.0, 25.0, 2, 10.0)
    columns = ["session_id", "person_id", "body_part", "object_id", "object_label", F.round("t_start", 6), F.round("t_end", 6), F.round("mean_distance_px", 6), "frames"]
    assert found.select(*columns).exceptAll(want.select(*columns)).count() == 0 and found.count() == want.count() > 0
    assert late.count() == 0


def test_a_silent_key_closes_beside_one_that_goes_on(spark, tmp_path):
    # Both keys are in one shard; the one that falls silent is closed by its own timer.
    folder = str(tmp_path / "in")
    write(spark, folder, [(s, "left", f, 3.0) for s in ("a", "b") for f in range(5)], 0)
    for k in range(1, 5):
        write(spark, folder, [("b", "left", 5 * k + f, 3.0) for f in range(5)], 20 * k)
    write(spark, folder, [("a", "left", 5, 3.0), ("a", "left", 6, 3.0)], 80)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
    found, late = contacts.run_contacts(contacts.contact_stream(stream, 15.0, 25.0, 2, 10, idle="30 minutes", shards=1), 10.0)
    # The contact of a ended at frame 4; when it came back, it began anew, and nothing of that or of b is closed yet.
    assert rows_of(found) == [("a", "left", 0.1, 0.4, 3.0, 4)]
    assert late.count() == 0
