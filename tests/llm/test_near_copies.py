from __future__ import annotations

import random
from collections import Counter, defaultdict

import plain
import pytest

import corpus_pipeline
from kinescribe.llm import simhash

DOCS = "doc_id long, text string, lang string"


def shingles(text):
    words = plain.folded(text).encode("utf-8", "surrogatepass").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """Smallest id of each component of "Jaccard of at least 0.8", for rows of (id, text), by counting shared shingles of all pairs."""
    rows = sorted(rows)
    sets, holders, parent = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        for j, both in Counter(j for s in own for j in holders[s]).items():
            if both * 5 >= 4 * (len(own) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(i)
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def stage_keeps(spark, docs):
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).select("doc_id").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_dedup_keeps_what_all_pairs_keep(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert stage_keeps(spark, docs) == kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_dedup_of_planted_edits(spark):
    # Edits of 0 to 8 % of the words: similarities on both sides of 0.8, and copies of copies.
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 40, 150, 700]))]
        for share in (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08):
            rows.append((n, " ".join(w if rng.random() > share else f"x{n}" for w in base)))
            n += 1
    rows += [(n, "One two"), (n + 1, "one  TWO"), (n + 2, "one two three")]
    got = stage_keeps(spark, spark.createDataFrame([(i, t, None) for i, t in rows], DOCS))
    assert got == kept(rows)


def test_near_dedup_of_odd_rows(spark):
    rows = [(3, None), (4, ""), (5, " \n"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "A b c d e f"), (8, "x " * 50_000), (9, "other words")]
    assert stage_keeps(spark, spark.createDataFrame([(i, t, None) for i, t in rows], DOCS)) == [3, 7, 8, 9]
    assert simhash.drop_similar(spark.createDataFrame([], DOCS)).count() == 0
