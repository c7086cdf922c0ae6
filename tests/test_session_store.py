"""Saves, crashes, compaction and pruning of the session store."""

from __future__ import annotations

import os

import pytest

from kinescribe.sources import sessions

TEXT = "session_id string, seg_idx bigint, text string"
TRACE = "session_id string, hand string, frame_idx bigint, x double"


def speech(spark, *rows):
    return spark.createDataFrame(list(rows), TEXT)


def texts(spark, root, ids=None):
    return sorted((r.session_id, r.seg_idx, r.text) for r in sessions.read_sessions(spark, root, ids)["transcript"].collect())


def files_of(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "manifest" not in d}


def test_many_saves_then_compaction(spark, tmp_path):
    root = str(tmp_path / "store")
    sessions.write_session({"transcript": speech(spark, *[(f"s{i}", 1, "first") for i in range(20)])}, root)
    want = {f"s{i}": "first" for i in range(20)}
    for save in range(3):
        before = files_of(root)
        sessions.write_session({"transcript": speech(spark, (f"s{save}", 1, f"again {save}"), (f"new {save}", 1, "x"))}, root)
        want |= {f"s{save}": f"again {save}", f"new {save}": "x"}
        # A save only adds files, and no more than its two sessions need.
        assert before <= files_of(root) and len(files_of(root)) <= len(before) + 2
    assert texts(spark, root) == sorted((s, 1, t) for s, t in want.items())
    assert texts(spark, root, ["s1", "s9", "nobody"]) == [("s1", 1, "again 1"), ("s9", 1, "first")]
    sessions.compact(spark, root)
    assert texts(spark, root) == sorted((s, 1, t) for s, t in want.items())
    assert len(sessions.vacuum(spark, root)) == 4 and len(sessions.versions(spark, root)) == 1
    assert texts(spark, root) == sorted((s, 1, t) for s, t in want.items())
    sessions.write_session({"transcript": speech(spark, ("s1", 2, "after"))}, root)
    assert texts(spark, root, ["s1"]) == [("s1", 2, "after")] and len(texts(spark, root)) == len(want)


def test_a_save_that_breaks_off_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    trace = spark.createDataFrame([("s", "left", 0, 1.0)], TRACE)
    sessions.write_session({"transcript": speech(spark, ("s", 1, "old")), "trace": trace}, root)

    class Broken(Exception):
        pass

    bucket, calls = sessions._bucket, []

    def breaks(column):
        calls.append(1)
        if len(calls) == 2:
            raise Broken
        return bucket(column)

    monkeypatch.setattr(sessions, "_bucket", breaks)
    with pytest.raises(Broken):
        # The first table is written, the second is not.
        sessions.write_session({"transcript": speech(spark, ("s", 1, "new")), "trace": trace}, root)
    monkeypatch.setattr(sessions, "_bucket", bucket)
    assert texts(spark, root) == [("s", 1, "old")]
    assert sessions.read_sessions(spark, root)["trace"].count() == 1
    sessions.vacuum(spark, root)
    assert len(files_of(root)) == 2 and texts(spark, root) == [("s", 1, "old")]


def test_tables_are_replaced_one_by_one(spark, tmp_path):
    root = str(tmp_path / "store")
    sessions.write_session({"transcript": speech(spark, ("s", 1, "a"), (None, 1, "nobody"), ("t", 1, "stays")), "trace": spark.createDataFrame([("s", "left", 0, 1.0)], TRACE)}, root)
    sessions.write_session({"transcript": speech(spark, ("s", 1, "b"), (None, 1, "nobody 2"))}, root)
    assert sorted(map(str, ((r.session_id, r.text) for r in sessions.read_sessions(spark, root)["transcript"].collect()))) == ["('s', 'b')", "('t', 'stays')", "(None, 'nobody 2')"]
    assert sessions.read_sessions(spark, root)["trace"].count() == 1
    with pytest.raises(FileNotFoundError):
        sessions.read_sessions(spark, str(tmp_path / "nothing"))
