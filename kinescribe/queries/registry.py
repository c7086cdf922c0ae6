"""All registered queries."""

from __future__ import annotations

from kinescribe.queries import borders, episode, motion, pose, speech, storage, topic  # noqa: F401
from kinescribe.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
