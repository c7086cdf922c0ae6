from __future__ import annotations

import io

import numpy as np
import pytest

from kinescribe.llm import toxicity
from kinescribe.llm.common import stage, with_place


def test_sample_has_a_hard_limit_and_a_share_of_unlabelled_rows(spark):
    # Half of the rows are copies of one text; a draw by the text takes all of them or none.
    rows = [(i, "same text" if i % 2 else f"text {i}") for i in range(2000)]
    docs = with_place(stage(spark.createDataFrame(rows, "doc_id long, text string")))
    told = set(range(0, 1800, 3))
    known = spark.createDataFrame([(i, 1) for i in sorted(told)], "doc_id long, toxic int")

    def ids(known, size):
        sample = toxicity.fit_sample(docs, known, size)
        found = [r.doc_id for r in docs.join(sample, ["_kinescribe_file", "_kinescribe_row"]).collect()]
        assert len(found) == len(set(found))
        return set(found)

    few = ids(known, 400)
    assert len(few & told) == 300 and len(few - told) == 100 and 25 < sum(i % 2 for i in few - told) < 75
    # More room adds rows; it does not replace any.
    assert few < ids(known, 800) and ids(known, 8000) == set(range(2000))
    assert len(ids(known.limit(0), 400)) == 100


def test_all_targets_are_posteriors(spark, monkeypatch):
    seen = []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "FIT_ROWS", 48)
    monkeypatch.setattr(toxicity, "FIT_ROUNDS", 3)
    monkeypatch.setattr(toxicity, "_fit", lambda file, lengths, target, weight: seen.append((target, weight)) or fit(file, lengths, target, weight))
    docs = spark.createDataFrame([(i, "copy" if i < 300 else f"w{i} bad" if i % 5 == 0 else f"w{i}") for i in range(600)], "doc_id long, text string")
    toxicity.train_toxicity(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300, 350)], "doc_id long, toxic int"))
    target, weight = seen[0]
    assert len(target) == 48 and ((target > 0) & (target < 1)).all()
    # A quarter of the rows and of the weight is unlabelled.
    assert np.isclose(weight, 1 / 48).all()


def test_label_model_reaches_the_scores_of_a_table_above_the_limit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 60)
    monkeypatch.setattr(toxicity, "FIT_ROUNDS", 20)
    docs = spark.createDataFrame([(i, f"w{i % 7} zorgish" if i % 4 == 0 else f"w{i % 7} fine") for i in range(400)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    fitted = toxicity.train_toxicity(docs, known)
    monkeypatch.setattr(toxicity, "label_model", lambda patterns, counts: np.full(len(patterns), 0.5))
    flat = toxicity.train_toxicity(docs, known)
    assert np.abs(fitted.weights - flat.weights).max() > 1e-3


def test_a_given_label_is_one_more_vote():
    posterior = np.array([0.0, 0.2, 0.5, 1.0])
    assert (toxicity.given(posterior, None) == posterior).all()
    assert np.allclose(toxicity.given(posterior, 1), [0, 0.19 / 0.23, 0.95, 1]) and np.allclose(toxicity.given(posterior, 0), [0, 0.01 / 0.77, 0.05, 1])
    assert np.allclose(toxicity.shares(np.array([True, False, False])), [0.75, 0.125, 0.125])
    assert np.allclose(toxicity.shares(np.array([False, False])), [0.5, 0.5]) and np.allclose(toxicity.shares(np.array([True])), [1])


def test_lexicons_are_those_of_a_plain_count(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        toxic = int(rng.random() < 0.3)
        rows.append((" ".join([f"w{i}" for i in rng.integers(0, 90, 12)] + [f"bad{i}" for i in rng.integers(0, 6, 2 * toxic)]), toxic))
    strong, weak = toxicity._lexicons(spark.createDataFrame(rows, "text string, toxic int"))
    piece = toxicity.Slice([" ".join(sorted({w for t, _ in rows for w in t.split()})).encode()])
    words = [piece.text(i, i + 1) for i in range(len(piece.hash))]
    buckets = next(toxicity._terms(piece)) & np.uint64(toxicity.TERM_BUCKETS - 1)
    for word, is_strong, is_weak in zip(words, toxicity._in(strong[0], buckets), toxicity._in(weak[0], buckets)):
        t, n = (sum(word in text.split() and label >= least for text, label in rows) for least in (1, 0))
        share, z = t / n, 1.64
        low = (share + z * z / (2 * n) - z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        assert (is_strong, is_weak) == (t >= 3 and low >= toxicity.STRONG, t >= 3 and toxicity.WEAK <= low < toxicity.STRONG)
    assert toxicity._in(strong[0], buckets).any()


@pytest.mark.parametrize("block", [1, 40, 1 << 19])
def test_descent_equals_dense_matrices_with_any_blocks(monkeypatch, block):
    monkeypatch.setattr(toxicity, "FIT_ROUNDS", 20)
    monkeypatch.setattr(toxicity, "FIT_BLOCK", block)
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(500, int(n), replace=False)).astype("<u4") for n in rng.integers(0, 30, 60)]
    lengths, target, weight = np.array([len(r) for r in rows]), rng.random(60), toxicity.shares(rng.random(60) < 0.5)
    got = toxicity._fit(io.BytesIO(b"".join(r.tobytes() for r in rows)), lengths, target, weight)

    x = np.zeros((60, 501))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(max(len(r), 1))
    x[:, -1] = 1
    toxic = 60 * (weight @ target)
    at = before = np.append(np.zeros(500), np.log((toxic + toxicity.PRIOR) / (61 - toxic - toxicity.PRIOR)))
    for k in range(1, 21):
        ahead = at + (k - 1) / (k + 2) * (at - before)
        slope = x.T @ (weight * (1 / (1 + np.exp(-x @ ahead)) - target)) + toxicity.PULL * np.append(ahead[:-1], 0)
        before, at = at, ahead - 4 / (2 + toxicity.VOTERS) * slope
    assert np.allclose(got[0][:500], at[:-1]) and np.isclose(got[1], at[-1])


def test_settings_of_the_fit_are_not_cut():
    assert toxicity.FIT_ROWS >= 16_384 and toxicity.FIT_ROUNDS >= 300
