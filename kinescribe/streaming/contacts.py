"""Contact events as a stream: a small state per person, body part and object, the keys; those of a shard of keys are saved together.

Frames may arrive in any order within ``delay`` frames of the newest one of their key. They wait in the state until the key's own clock
(its newest frame) has passed them by ``delay``, then go through the contact rule in order. The state holds those frames, the
flags of the last few frames and the open contact, so its size does not grow with the recording. A frame that comes later than that is
not dropped: it leaves the stream as a row of its own kind. A key of which nothing has arrived for ``idle`` is closed by a timer: its
waiting frames are used, an open contact ends with its last frame, and its state is removed. A shard's timer is that of the key that is closed first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.operators.contacts import KEYS
from kinescribe.plans.staging import fresh_folder

#: kind is "contact" or "late"; a late frame has its number, distance and label.
_ROWS = (
    "session_id string, person_id int, body_part string, object_id int, kind string, object_label string, start_frame long, end_frame long, "
    "total double, frames long"
)
_COLUMNS = [part.split()[0] for part in _ROWS.split(", ")]
#: A list with an item per key, as JSON: the key, when it is closed if nothing arrives, and the values of ``_Machine.saved``.
_STATE = "keys string"
#: Newest frame, number of the last frame used, state, flags of the last frames (near, far), open contact (label, first and last frame, total,
#: frames), waiting frames (number, distance, label).
_START = (-1, -1, False, [], [], None, None, None, 0.0, 0, [], [], [])
#: Shards of keys; a call takes the frames of all keys of one, as calls and states cost more than a key's few frames.
SHARDS = 1024


def _all_recent(flags: np.ndarray, before: list[bool], frames: int) -> np.ndarray:
    """Whether a frame and the ``frames`` - 1 before it all have the flag; ``before`` are the flags of earlier frames."""
    padded = np.concatenate([np.zeros(frames - 1, bool), np.array(before, bool), flags]).astype(np.int64)
    return (np.convolve(padded, np.ones(frames, np.int64), "valid") == frames)[-len(flags) :]


class _Machine:
    """The contact rule over the frames of one key, from a saved state on."""

    def __init__(self, state: tuple, touch: float, release: float, frames: int):
        self.newest, self.used, self.touching, near, far, self.label, self.start, self.end, self.total, self.count, *waiting = state
        self.near, self.far = list(near), list(far)
        self.waiting, self.waiting_distance, self.waiting_label = np.array(waiting[0], np.int64), np.array(waiting[1], float), np.array(waiting[2], object)
        self.touch, self.release, self.k = touch, release, frames

    def saved(self) -> tuple:
        return (
            self.newest, self.used, self.touching, self.near, self.far, self.label, self.start, self.end, self.total, self.count,
            self.waiting.tolist(), self.waiting_distance.tolist(), self.waiting_label.tolist(),
        )

    def add(self, rows: Mapping[str, Sequence]) -> list[tuple]:
        """Take frames in (frame_idx, distance_px, object_label); what came too late is returned."""
        frame, distance, label = np.asarray(rows["frame_idx"], np.int64), np.asarray(rows["distance_px"], float), np.asarray(rows["object_label"], object)
        late = frame <= self.used
        self.newest = max(self.newest, int(frame.max()))
        came_late = [("late", label[i], int(frame[i]), int(frame[i]), float(distance[i]), 1) for i in np.flatnonzero(late).tolist()]
        if came_late:
            frame, distance, label = frame[~late], distance[~late], label[~late]
        self.waiting = np.concatenate([self.waiting, frame])
        self.waiting_distance = np.concatenate([self.waiting_distance, distance])
        self.waiting_label = np.concatenate([self.waiting_label, label])
        return came_late

    def use(self, until: int | None) -> list[tuple]:
        """Use the waiting frames up to ``until`` (all of them, if None); contacts that have ended."""
        ready = self.waiting <= until if until is not None else np.ones(len(self.waiting), bool)
        if not ready.any():
            return []
        order = np.flatnonzero(ready)[np.argsort(self.waiting[ready], kind="stable")]
        frame, distance, label = self.waiting[order], self.waiting_distance[order], self.waiting_label[order]
        self.waiting, self.waiting_distance, self.waiting_label = self.waiting[~ready], self.waiting_distance[~ready], self.waiting_label[~ready]
        near, far = distance < self.touch, distance > self.release
        signal = np.where(_all_recent(near, self.near, self.k), 1, np.where(_all_recent(far, self.far, self.k), 0, -1))
        self.near, self.far = ([*old, *new.tolist()][len(old) + len(new) - min(self.k - 1, len(old) + len(new)) :] for old, new in ((self.near, near), (self.far, far)))
        last = np.maximum.accumulate(np.where(signal >= 0, np.arange(len(signal)), -1))
        state = np.where(last >= 0, signal[last] == 1, self.touching)
        self.used = int(frame[-1])
        ended = []
        edges = [0, *(np.flatnonzero(state[1:] != state[:-1]) + 1).tolist(), len(state)]
        for a, b in zip(edges, edges[1:]):
            if not state[a]:
                ended += self.close()
                continue
            if not self.count:
                self.start, self.label = int(frame[a]), label[a]
            self.end = int(frame[b - 1])
            self.total += float(distance[a:b].sum())
            self.count += b - a
        self.touching = bool(state[-1])
        return ended

    def close(self) -> list[tuple]:
        """The open contact, if there is one."""
        ended = [("contact", self.label, self.start, self.end, self.total, self.count)] if self.count else []
        self.label, self.start, self.end, self.total, self.count = None, None, None, 0.0, 0
        return ended


def _by_key(rows: pd.DataFrame) -> Iterator[tuple[tuple, int, dict[str, np.ndarray]]]:
    """(key, time of its newest row in milliseconds, its frames by column) for each key; rows without a number or distance are no frames."""
    code = np.zeros(len(rows), np.int64)
    for name in KEYS:
        own, values = pd.factorize(rows[name], use_na_sentinel=False)
        code = np.unique(code * len(values) + own, return_inverse=True)[1].reshape(-1)
    order = np.argsort(code, kind="stable")
    edges = [0, *np.cumsum(np.bincount(code)).tolist()]
    firsts = rows[KEYS].iloc[order[edges[:-1]]].astype(object)
    keys = firsts.where(firsts.notna(), None).itertuples(index=False, name=None)
    arrived = rows["arrived"].to_numpy("datetime64[ms]").astype(np.int64)[order]
    frame, distance, label = (rows[c].to_numpy()[order] for c in ("frame_idx", "distance_px", "object_label"))
    kept = ~(pd.isna(frame) | pd.isna(distance))
    for (session, person, part, thing), a, b in zip(keys, edges, edges[1:]):
        some = kept[a:b]
        frames = {"frame_idx": frame[a:b][some], "distance_px": distance[a:b][some], "object_label": label[a:b][some]}
        yield (session, person if person is None else int(person), part, thing if thing is None else int(thing)), max(0, int(arrived[a:b].max())), frames


def contact_stream(distances: DataFrame, touch: float, release: float, frames: int, delay: int, idle: str = "10 minutes", slack: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """Contacts that have ended and frames that came too late, as rows (KEYS, kind, object_label, start_frame, end_frame, total, frames).

    ``distances``: KEYS, object_label, frame_idx, distance_px, ``arrived`` (when the row reached the store; rows that were received up to ``slack`` earlier
    than the newest ones are still taken, and so are those of the newest ones' own time, however many batches they fill). Frames with a null number or distance are no frames. A row without a session is a heartbeat: it moves
    the clock by which idle keys are closed, and nothing else. ``shards`` must stay the same for a checkpoint.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)
    # A row as old as the watermark is dropped by Spark, so the watermark stays a millisecond behind the newest rows.
    behind = int(pd.Timedelta(slack).total_seconds() * 1000) + 1

    def step(shard: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if shard[0] < 0:
            return
        saved = {tuple(key): (closes, values) for key, closes, values in json.loads(state.get[0])} if state.exists else {}
        now = state.getCurrentWatermarkMs()
        out: list[tuple] = []
        if not state.hasTimedOut:
            # All at once, as the parts of one batch are in no order.
            for key, seen, rows in _by_key(pd.concat(list(parts), ignore_index=True)):
                machine = _Machine(saved[key][1] if key in saved else _START, touch, release, frames)
                found = machine.add(rows) if len(rows["frame_idx"]) else []
                found += machine.use(machine.newest - delay)
                out += [(*key, *row) for row in found]
                saved[key] = (max(seen, now) + pause, machine.saved())
        # A key that has rows now closes later, so this closes silent ones only.
        for key in [key for key, (closes, _) in saved.items() if closes < now]:
            machine = _Machine(saved.pop(key)[1], touch, release, frames)
            out += [(*key, *row) for row in machine.use(None) + machine.close()]
        if saved:
            state.update((json.dumps([(key, *rest) for key, rest in saved.items()], separators=(",", ":")),))
            state.setTimeoutTimestamp(min(closes for closes, _ in saved.values()))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    timed = distances.select(
        F.col("session_id").cast("string").alias("session_id"), F.col("person_id").cast("int").alias("person_id"), "body_part",
        F.col("object_id").cast("int").alias("object_id"), "object_label", F.col("frame_idx").cast("long").alias("frame_idx"),
        F.col("distance_px").cast("double").alias("distance_px"), "arrived",
    ).withWatermark("arrived", f"{behind} milliseconds")
    shard = F.when(F.col("session_id").isNull(), -1).otherwise(F.pmod(F.xxhash64(*KEYS), F.lit(shards))).cast("int")
    return timed.withColumn("shard", shard).groupBy("shard").applyInPandasWithState(step, _ROWS, _STATE, "append", "EventTimeTimeout")


def run_contacts(events: DataFrame, fps: float, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a ``contact_stream`` over what is there now; all contacts and all late frames so far.

    ``base`` holds the checkpoint and both tables: a run with the same ``base`` goes on where the one before ended. A micro-batch that is
    repeated after a failure replaces its own rows.
    """
    spark = events.sparkSession
    base = base or fresh_folder(spark, "contacts")
    tables = {"contact": f"{base}/contacts", "late": f"{base}/late"}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for kind, path in tables.items():
            batch.where(F.col("kind") == kind).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    stream = events.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    stream.foreachBatch(write).start().awaitTermination()
    found, late = (spark.read.schema(events.schema).parquet(path) for path in tables.values())
    contacts = found.select(
        *KEYS, "object_label", (F.col("start_frame") / fps).alias("t_start"), (F.col("end_frame") / fps).alias("t_end"),
        (F.col("total") / F.col("frames")).alias("mean_distance_px"), "frames",
    )
    return contacts, late.select(*KEYS, "object_label", F.col("start_frame").alias("frame_idx"), F.col("total").alias("distance_px"))
