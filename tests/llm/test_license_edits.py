from __future__ import annotations

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from kinescribe.llm import licenses, queries
from kinescribe.llm.word_hashes import Slice


def words(text):
    piece = Slice([text.encode()])
    return [piece.text(i, i + 1) for i in range(len(piece.hash))]


def most_in_order(text, template):
    row = [0] * (len(text) + 1)
    for w in template:
        new = [0]
        for j, t in enumerate(text):
            new.append(max(row[j] + (t == w), row[j + 1], new[j]))
        row = new
    return row[-1]


def found(text, name):
    index = licenses.build_index(licenses.NOTICES)
    return [m for m in licenses.scan([" ".join(text)], index)[0] if m["template"] == name]


@pytest.mark.parametrize("name", sorted(licenses.NOTICES))
def test_one_word_edits_at_each_place(name):
    template = words(licenses.NOTICES[name])
    before, after = [f"b{i}" for i in range(30)], [f"a{i}" for i in range(30)]
    for at in range(len(template)):
        edits = [template[:at] + ["zzz"] + template[at + 1 :], template[:at] + template[at + 1 :], template[:at] + ["zzz"] + template[at:]]
        for edited in edits:
            most = most_in_order(edited, template)
            got = found(before + edited + after, name)
            assert [m["matched"] for m in got] == ([most] if most >= licenses.COVERAGE * len(template) else [])
            assert all(30 <= m["start"] < m["end"] <= 30 + len(edited) for m in got)


@pytest.mark.parametrize("name", sorted(licenses.NOTICES))
def test_every_fifth_word_changed(name):
    template = words(licenses.NOTICES[name])
    for shift in range(5):
        edited = [w if i % 5 != shift else "zzz" for i, w in enumerate(template)]
        most = most_in_order(edited, template)
        assert [m["matched"] for m in found(["x"] * 9 + edited, name)] == ([most] if most >= licenses.COVERAGE * len(template) else [])


def test_random_edits_of_all_notices():
    # At most BAND changes of place, so that every alignment lies within the band of each of its words.
    rng = random.Random(7)
    for _ in range(300):
        name = rng.choice(sorted(licenses.NOTICES))
        template = words(licenses.NOTICES[name])
        edited = list(template)
        for _ in range(rng.randrange(licenses.BAND)):
            at = rng.randrange(len(edited) + 1)
            edited[at : at + rng.randrange(2)] = ["zzz"] * rng.randrange(2)
        most = most_in_order(edited, template)
        assert [m["matched"] for m in found(["q"] * rng.randrange(20) + edited + ["q"] * 20, name)] == ([most] if most >= licenses.COVERAGE * len(template) else [])


def test_spans_are_what_the_longest_run_must_have():
    for n in range(1, 400):
        missed = sum(n - e >= licenses.COVERAGE * n for e in range(1, n + 1))
        # Words that stay, spread as evenly as possible over the runs between all changes.
        runs = [len(r) for r in np.array_split(np.arange(n - missed), missed + licenses.BAND + 1)]
        assert licenses.span_of(n, licenses.COVERAGE) == max(runs + [1])


def test_index_holds_winnowed_fingerprints():
    index = licenses.build_index(licenses.TEMPLATES)
    for t, name in enumerate(index.names):
        span = licenses.span_of(len(index.words[t]), licenses.COVERAGE)
        places = np.sort(index.prints[span][2][index.prints[span][1] == t])
        k = span // 2 + 1
        # Every window has one, and grams that win in no window are left out.
        assert all(((places >= at) & (places + k <= at + span)).any() for at in range(len(index.words[t]) - span + 1))
    hashes = index.prints[licenses.span_of(len(index.words[index.names.index("zlib")]), licenses.COVERAGE)][0]
    assert set(index.prints) == {1, 2, 3, 4} and len(hashes) < sum(len(w) for w in index.words)


@pytest.mark.parametrize("name", ["bsd-3-clause", "mit-text", "gpl-3.0-notice", "zlib"])
def test_random_edits_of_whole_texts(name):
    rng = random.Random(11)
    template = words(licenses.TEMPLATES[name])
    for _ in range(12):
        edited = [w if rng.random() > rng.choice([0.05, 0.15, 0.22]) else "zzz" for w in template]
        for _ in range(rng.randrange(licenses.BAND)):
            edited.insert(rng.randrange(len(edited) + 1), "yyy")
        most = most_in_order(edited, template)
        got = licenses.scan([" ".join(["q"] * 9 + edited)], licenses.build_index({name: licenses.TEMPLATES[name]}))[0]
        assert [m["matched"] for m in got] == ([most] if most >= licenses.COVERAGE * len(template) else [])


def test_query_equals_alignment_on_every_diagonal(spark):
    """All diagonals of all documents and templates, without fingerprints."""
    sf = "/root/testdata/sf0.001"
    want = {}
    parts = {name: Slice([text.encode()]).hash for name, text in licenses.TEMPLATES.items()}
    for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        text = Slice([(r["text"] or "").encode()]).hash
        for name, template in parts.items():
            n, band = len(template), licenses.BAND
            # Which template words are near which diagonal; a diagonal d is column d + n.
            bound = np.zeros(len(text) + n, np.int64)
            for i in range(n):
                near = np.zeros(len(bound) + 1, np.int64)
                at = np.flatnonzero(text == template[i]) - i + n
                np.add.at(near, np.maximum(at - band, 0), 1)
                np.add.at(near, np.minimum(at + band + 1, len(bound)), -1)
                bound += np.cumsum(near)[:-1] > 0
            scores = [licenses.align(text, template, int(d) - n)[0] for d in np.flatnonzero(bound >= licenses.COVERAGE * n)]
            if scores and max(scores) >= licenses.COVERAGE * n:
                want[r["doc_id"], name] = max(scores)
    got = {}
    for r in queries.QUERIES["op4_license_scan"](spark, sf).collect():
        got[r.doc_id, r.template] = max(got.get((r.doc_id, r.template), 0), r.matched)
    assert got == want and len(want) > 0


def test_many_words_that_cannot_match_cost_little():
    index, start = licenses.build_index(licenses.TEMPLATES), time.time()
    assert licenses.scan(["license " * 200_000], index) == [[]] and time.time() - start < 30
