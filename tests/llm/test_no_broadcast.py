"""Exploded tables are larger than Spark takes them for, so they must never be broadcast."""

from __future__ import annotations

import random

from kinescribe.llm import minhash, simhash


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_keys_are_not_broadcast(spark, tmp_path):
    rng = random.Random(5)
    rows = [(fp, fp) for fp in (rng.getrandbits(63) for _ in range(50))]
    spark.createDataFrame(rows, "fp long, component long").write.parquet(str(tmp_path / "rough"))
    rough = spark.read.parquet(str(tmp_path / "rough"))
    for pairs in (simhash.star_pairs(rough), simhash._bridges(rough, simhash.DISTANCE)):
        assert "SortMergeJoin" in planned(pairs) and "Broadcast" not in planned(pairs)


def test_bands_are_not_broadcast(spark, tmp_path):
    rows = [(n, 9, [n * 48 + i % 40 for i in range(48)]) for n in range(40)]
    spark.createDataFrame(rows, "node long, size long, bands array<long>").write.parquet(str(tmp_path / "nodes"))
    shared = minhash._shared(spark.read.parquet(str(tmp_path / "nodes")))
    assert "SortMergeJoin" in planned(shared) and "Broadcast" not in planned(shared)
