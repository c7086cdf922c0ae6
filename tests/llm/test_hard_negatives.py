"""Hard negatives against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinescribe.llm import hard_negatives
from kinescribe.llm.hard_negatives import Lists, best_in_window

ROWS = "vec_id long, label int, embedding array<float>"


def by_all_pairs(rows, every=10):
    used = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, l, v) in enumerate(used):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, k) for m, (j, k, w) in enumerate(used) if len(w) == len(v)]
        for s, j, m, _ in sorted(x for x in scored if x[3] == l and x[2] != n)[:5]:
            inside = sorted(x for x in scored if x[3] != l and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, rank, y, -s, -t) for rank, (t, y, _, _) in enumerate(inside, 1)]
    return sorted(out)


def got(spark, rows, every=10):
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(spark.createDataFrame(rows, ROWS), F.col("id") % every == 0).collect())


def vectors(seed, n, dims=8, step=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0.1, 1) for _ in range(dims)]
        rows.append((i, rng.randrange(3), [round(x / step) * step for x in v] if step else v))
    return rows


@pytest.mark.parametrize("block", [1 << 13, 60])
def test_all_pairs_in_one_and_in_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    # Coarse components make many equal scores; the odd rows take no part, or have vectors of another length.
    odd = [(None, 1, [1.0] * 8), (500, None, [1.0] * 8), (510, 1, None), (520, 1, []), (530, 1, [1.0, None]), (540, 1, [float("nan")] * 8), (550, 2, [float("inf")] * 8)]
    short = [(600 + i, i % 2, [float(i), 1.0]) for i in range(25)]
    rows = vectors(1, 400, step=0.5) + odd + short + [(700, 1, [0.0] * 8), (710, 1, [1e6, -1e6] * 4), (20, 0, [0.5] * 8), (20, 0, [0.5] * 8)]
    assert got(spark, rows) == by_all_pairs(rows)


def test_sums_beyond_doubles(spark):
    rows = [(i, l, [x * 2.0**21 for x in v]) for i, l, v in vectors(2, 120)]
    assert got(spark, rows) == by_all_pairs(rows)


def test_few_rows_and_empty_tables(spark):
    assert got(spark, vectors(3, 12)) == by_all_pairs(vectors(3, 12))
    assert got(spark, []) == [] and got(spark, [(1, 1, [1.0])]) == [] and got(spark, [(0, 1, [1.0])]) == []
    extra = spark.createDataFrame([(0, 1, [1.0], 5, 6), (1, 1, [1.0], 5, 6), (2, 0, [0.5], 5, 6)], ROWS + ", score int, row int")
    assert [tuple(r) for r in hard_negatives.mine_hard_negatives(extra, F.col("id") % 10 == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]


def test_reading_stops_early():
    # One row stands out in every list, so a look at the tops is enough.
    rng = np.random.default_rng(0)
    v = rng.integers(-10, 10, (4000, 4)).astype(float)
    v[77] = 1000.0
    lists = Lists(v, np.arange(4000), np.zeros(4000, int), np.arange(4000))
    met = []
    for found, _, threshold in lists.met(np.array([1.0, 1.0, 1.0, 1.0])):
        met.extend(found.tolist())
        if threshold < 4000:
            break
    assert 77 in met and len(met) <= 4 * hard_negatives.DEPTH
    assert best_in_window(lists, np.array([1.0, 1.0, 1.0, 1.0]), np.ones(4000, bool), [None], 1) == [[77]]
    # The threshold bounds every row that was not met, at every depth.
    anchor = rng.integers(-5, 5, 4).astype(float)
    scores, seen = v @ anchor, set()
    for found, _, threshold in lists.met(anchor):
        seen |= set(found.tolist())
        rest = np.setdiff1d(np.arange(4000), list(seen))
        assert not len(rest) or scores[rest].max() <= threshold
    assert len(seen) == 4000
