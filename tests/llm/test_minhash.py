"""The MinHash operator against all pairs of sets."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import plain
import pytest

from kinescribe.llm import minhash, queries

DOCS = "doc_id long, text string, lang string"


def shingle_set(text, shingle=2):
    words = [w.decode("utf-8", "surrogatepass") for w in plain.folded(text).encode("utf-8", "surrogatepass").split()]
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def by_all_pairs(rows, shingle=2):
    """(id, size of the set, smallest id reachable, kept) for rows of (id, text), by counting shared shingles of all pairs."""
    sets, holders, parent = [shingle_set(t, shingle) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        for j, both in Counter(j for s in own for j in holders[s]).items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                parent[find(i)] = find(j)
        for s in own:
            holders[s].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


def got(found):
    return sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_finds_what_all_pairs_find(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op13_minhash"](spark, f"/root/testdata/{sf}")) == sorted(by_all_pairs(rows))


def edited(seed, bases, shares, sizes=(6, 30, 120, 500)):
    rng, rows = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice(sizes))]
        rows += [" ".join(w if rng.random() > share else f"x{rng.randrange(10**9)}" for w in base) for share in shares]
    return list(enumerate(rows))


def test_planted_edits_on_both_sides_of_the_border(spark):
    rows = edited(3, 40, (0, 0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.12))
    assert got(minhash.near_duplicates(spark.createDataFrame([(i, t, None) for i, t in rows], DOCS))) == sorted(by_all_pairs(rows))


@pytest.mark.parametrize("block", [40, 2000])
def test_a_large_group_is_cut_into_blocks(spark, monkeypatch, block):
    # One text with copies of copies, some beyond the border: many components that share bands.
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = edited(5, 2, [0.01] * 20 + [0.05] * 60 + [0.09] * 40, sizes=(150,))
    assert got(minhash.near_duplicates(spark.createDataFrame([(i, t, None) for i, t in rows], DOCS))) == sorted(by_all_pairs(rows))


def test_recall_of_the_bands_alone():
    # Two sets of similarity 0.8 share one of the bands nearly always, dissimilar ones hardly ever.
    import numpy as np

    rng, met = np.random.default_rng(1), Counter()
    for _ in range(1500):
        for share, name in ((0.8, "near"), (0.3, "far")):
            n = 300
            both = round(2 * n * share / (1 + share))
            common = rng.integers(0, 1 << 63, both, dtype=np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - both, dtype=np.uint64)]) for _ in range(2))
            met[name] += bool((minhash.bands_of(a) == minhash.bands_of(b)).any())
    assert met["near"] >= 1490 and met["far"] <= 15


def test_odd_rows(spark):
    rows = [(3, None), (4, ""), (5, " \n"), (None, "a b c d"), (7, "a b c d"), (7, "A b C d"), (8, "x " * 60_000), (9, "other"), (10, "OTHER"), (None, None), (None, "nobody else"), (11, "é É ß")]
    # The word sequence of one word is its shingle; rows without words are alone.
    want = [(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 3, 7, False), (7, 3, 7, True), (7, 3, 7, True), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 9, False), (None, 0, None, True), (None, 1, None, True), (11, 2, 11, True)]
    found = minhash.near_duplicates(spark.createDataFrame([(i, t, "_id") for i, t in rows], DOCS), carry=["lang"])
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept", "lang"]
    assert sorted(map(str, (tuple(r)[:4] for r in found.collect()))) == sorted(map(str, want))
    left = minhash.drop_near_copies(spark.createDataFrame([(i, t, "l") for i, t in rows], DOCS))
    assert left.columns == ["doc_id", "text", "lang"] and sorted(str(r.doc_id) for r in left.collect()) == sorted(["3", "4", "5", "7", "8", "9", "None", "None", "11"])


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_copies(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 1, 2), (2, "a b c", 3, 4)], "doc_id long, text string, node long, size long")
    assert [(r.doc_id, r.node, r.size) for r in minhash.drop_near_copies(clash).collect()] == [(1, 1, 2)]


def test_settings_of_the_session_are_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    minhash.near_duplicates(spark.createDataFrame([(1, "a b", None)], DOCS)).count()
    assert spark.conf.get(key) == before
