"""Explicit schemas of the session tables. See the README for the meaning of each table."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOLEAN, TIME = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(required: dict[str, T.DataType], **optional: T.DataType) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    return T.StructType(fields + [T.StructField(n, t) for n, t in optional.items()])


POINT = _struct({}, x=DOUBLE, y=DOUBLE, z=DOUBLE, visibility=DOUBLE)
POINT_2D = _struct({}, x=DOUBLE, y=DOUBLE)
_FRAME = {"session_id": STRING, "frame_idx": LONG}

SESSIONS = _struct(
    {"session_id": STRING}, video_path=STRING, width=INT, height=INT, fps=DOUBLE, total_frames=LONG, backend=STRING,
    has_hands=BOOLEAN, audio_summary=STRING, version=DOUBLE, saved_at=TIME,
)
HAND_FRAMES = _struct({**_FRAME, "hand_no": INT}, hand=STRING, landmarks=T.ArrayType(POINT))
BODY_FRAMES = _struct({**_FRAME, "person_no": INT}, part=STRING, keypoints=T.ArrayType(POINT))
POSE_RAW = _struct(
    {**_FRAME, "person_no": INT}, bbox_score=DOUBLE, keypoints=T.ArrayType(POINT_2D), scores=T.ArrayType(DOUBLE)
)
GESTURES = _struct({**_FRAME, "hand": STRING}, gesture=STRING, score=DOUBLE)
TRACE = _struct({"session_id": STRING, "hand": STRING, "frame_idx": LONG}, ts=DOUBLE, x=DOUBLE, y=DOUBLE, z=DOUBLE)
WORDS = _struct({"session_id": STRING, "chunk_idx": INT, "word_idx": INT}, word=STRING, start_s=DOUBLE, end_s=DOUBLE)
TRANSCRIPT = _struct(
    {"session_id": STRING, "seg_idx": LONG}, start_s=DOUBLE, end_s=DOUBLE, text=STRING, sentiment=STRING, sentiment_score=DOUBLE
)
LEXICON = _struct({}, category=STRING, terms=T.ArrayType(STRING))
CONTACTS_IN = _struct(_FRAME, person_id=INT, body_part=STRING, object_id=INT, object_label=STRING, distance_px=DOUBLE)

#: Tables of a saved session.
SESSION_TABLES: dict[str, T.StructType] = {
    "sessions": SESSIONS,
    "hand_frames": HAND_FRAMES,
    "body_frames": BODY_FRAMES,
    "gestures": GESTURES,
    "trace": TRACE,
    "transcript": TRANSCRIPT,
}
