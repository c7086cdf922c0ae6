"""Queries with chunks of a few rows, so that real rows lie on chunk borders; their SQL twins know no chunks."""

from __future__ import annotations

from kinescribe.queries import episode, motion, speech, storage
from kinescribe.queries.base import ORACLES, query

#: Rows per chunk. Keys of the small test tables have about fifty rows, sentences reach over many words.
FEW, SOME = 7, 300

for _name, _of, _rows in (
    ("trace_filtered", motion.trace_filtered, FEW), ("step_speeds", motion.step_speeds, FEW), ("derivatives", motion.derivatives, FEW),
    ("phase_runs", motion.phase_runs, FEW), ("reach_runs", motion.reach_runs, FEW), ("episodes", episode.episodes, FEW),
    ("episode_kinematics", episode.episode_kinematics, FEW), ("contact_events", storage.contact_events, FEW), ("sentences", speech.sentences, SOME),
):
    query(f"{_name}_at_borders", ORACLES[_name])(lambda spark, sf, of=_of, rows=_rows: of(spark, sf, rows))
