"""Shards of nearly equal bytes, by sampled splitters.

Rows are ordered by the hash of their text, so equal texts are neighbours. Groups of equal texts that hold more than one
unit (a share of 1 / ``FINE`` of a shard) are few by their size, at most ``shards`` x ``FINE``; they are listed. From the
other groups keys are drawn with a chance in proportion to their bytes, and the weighted quantiles of the sample become
splitters of about ``shards`` x ``FINE`` ranges. The bytes of each range are then counted exactly, and a range with more
than twice its share gets further splitters from a sample of its own.

A listed group goes to the emptiest shard if it fits there, else its rows are divided between the shards that have room.
The ranges then fill up the shards in the order of their keys. All shards come out within a few units of each other,
which is the law ``bytes``. A listed group also counts in parts of one unit, so no task ranks more than a few units of
rows. What the driver and the tasks hold is a few numbers per unit, whatever the size of the table.

Edge cases: a null text has no bytes but its row has size 1. Rows are told apart by their place, so repeated rows get slots
of their own. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.llm.common import stage, with_row

LAW = "bytes"
#: Units of a shard.
FINE = 512
#: Expected samples per range.
DRAWS = 16
#: Rounds of subdivision; a round halves what is overfull with near certainty.
ROUNDS = 8


@dataclass(frozen=True)
class Units:
    """How rows fall into units: a range between ``splitters``, or a part of a listed group."""

    splitters: np.ndarray
    listed: np.ndarray
    parts: np.ndarray

    def of(self, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """Unit of each row. Ranges come first; then the parts of the first listed group, and so on."""
        unit = np.searchsorted(self.splitters, keys, "right")
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, keys), len(self.listed) - 1)
            base = len(self.splitters) + 1 + np.concatenate([[0], np.cumsum(self.parts)[:-1]])
            share = (salts.view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
            part = base[at] + np.minimum((share * self.parts[at]).astype(np.int64), self.parts[at] - 1)
            unit = np.where(self.listed[at] == keys, part, unit)
        return unit


def _unit_column(units: Units) -> Column:
    def of(keys: pa.Array, salts: pa.Array) -> pa.Array:
        return pa.array(units.of(keys.to_numpy(zero_copy_only=False), salts.to_numpy(zero_copy_only=False)), pa.int64())

    return F.arrow_udf(of, "long")("key", "salt")


def _drawn(groups: DataFrame, per_draw: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn once per ``per_draw`` bytes on average, sorted, with the bytes that each stands for."""
    chance = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)) * per_draw
    rows = groups.where(chance < F.col("bytes")).select("key", "bytes").toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), np.maximum(rows["bytes"].to_numpy(float), per_draw)


def _quantiles(keys: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """Keys at which ranges of about ``share`` bytes begin."""
    number = (np.cumsum(weights) // share).astype(np.int64)
    return keys[1:][np.diff(number) > 0]


def _units(groups: DataFrame, total: int, shards: int) -> Units:
    share = total / (shards * FINE)
    listed = groups.where(F.col("bytes") > share).select("key", "bytes").toPandas().sort_values("key")
    rest = groups.where(F.col("bytes") <= share)
    splitters = _quantiles(*_drawn(rest, share / DRAWS, 0), share)
    for seed in range(1, ROUNDS):
        units = Units(splitters, np.zeros(0, np.int64), np.zeros(0, np.int64))
        ranges = rest.withColumn("salt", F.lit(0).cast("long")).withColumn("unit", _unit_column(units))
        full = ranges.groupBy("unit").agg(F.sum("bytes").alias("b")).where(F.col("b") > 2 * share).select("unit").toPandas()["unit"].tolist()
        if not full:
            break
        keys, weights = _drawn(ranges.where(F.col("unit").isin(full)), share / DRAWS / 2**seed, seed)
        splitters = np.union1d(splitters, _quantiles(keys, weights, share / 2))
    parts = np.ceil(listed["bytes"].to_numpy(float) / share).astype(np.int64)
    return Units(splitters, listed["key"].to_numpy(np.int64), parts)


def _assigned(units: Units, sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit from the bytes of the units."""
    target = sizes.sum() / shards
    load = np.zeros(shards)
    shard = np.zeros(len(sizes), np.int64)
    n_ranges = len(units.splitters) + 1
    edges = n_ranges + np.concatenate([[0], np.cumsum(units.parts)]).astype(np.int64)
    groups = sorted(zip(edges[:-1].tolist(), edges[1:].tolist()), key=lambda e: (-sizes[e[0] : e[1]].sum(), e))
    split: list[int] = []
    for a, b in groups:
        size = sizes[a:b].sum()
        low = int(load.argmin())
        if load[low] + size <= target:
            shard[a:b] = low
            load[low] += size
        else:
            split += range(a, b)
    for u in sorted(split, key=lambda u: (-sizes[u], u)):
        low = int(load.argmin())
        shard[u] = low
        load[low] += sizes[u]
    at = 0
    for u in range(n_ranges):
        # The range goes where most of it fits; what a shard has too much or too little is made up by the next one.
        while at < shards - 1 and load[: at + 1].sum() + sizes[u] / 2 > target * (at + 1):
            at += 1
        shard[u] = at
        load[at] += sizes[u]
    return shard


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` (its place in the shard) and the columns ``carry``."""
    bytes_ = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    carried = F.struct(*carry, F.lit(0).alias("_")).alias("carried")
    rows = with_row(docs.select(F.col(doc_id).alias("doc_id"), bytes_.alias("b"), carried))
    rows = rows.select("doc_id", "carried", "_row", (F.length("b") + 1).cast("long").alias("size"), F.crc32("b").alias("text_crc32"), F.xxhash64("b").alias("key"))
    rows = stage(rows.withColumn("salt", F.xxhash64("_row")))
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    units = _units(groups, total, shards) if total else Units(*[np.zeros(0, np.int64)] * 3)

    placed = rows.withColumn("unit", _unit_column(units))
    counted = placed.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas()
    n_units = len(units.splitters) + 1 + int(units.parts.sum())
    sizes, counts = np.zeros(n_units), np.zeros(n_units, np.int64)
    sizes[counted["unit"].to_numpy(np.int64)] = counted["bytes"]
    counts[counted["unit"].to_numpy(np.int64)] = counted["n"]
    shard = _assigned(units, sizes, shards)
    base = np.zeros(n_units, np.int64)
    for s in range(shards):
        base[shard == s] = np.cumsum(counts[shard == s]) - counts[shard == s]

    def first_slot(numbers: pa.Array) -> pa.Array:
        u = numbers.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(shard[u], pa.int32()), pa.array(base[u])], ["shard", "base"])

    rank = F.row_number().over(Window.partitionBy("unit").orderBy("key", "salt", "_row")) - 1
    ranked = placed.withColumn("rank", rank).withColumn("place", F.arrow_udf(first_slot, "shard int, base long")("unit"))
    return ranked.select(
        F.col("doc_id").alias(doc_id), "size", "text_crc32", F.lit(LAW).alias("law"), F.col("place.shard").alias("shard"),
        (F.col("place.base") + F.col("rank")).cast("long").alias("slot"), *[F.col("carried")[c].alias(c) for c in carry],
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write rows of :func:`shard_documents` (with the columns to be stored carried along) as a folder per shard, in the order of their slots."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
