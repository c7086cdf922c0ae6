"""Phrase collocations against a plain program."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import plain
import pytest

from kinescribe.llm import collocations

DOCS = "text string, lang string"


def by_hand(rows, support, best, longest=4):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.folded(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found = []
        candidates = [p for p, n in f.items() if len(p) > 1 and n >= support]
        for p in candidates:
            a = f[p]
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * f[q] >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in candidates)
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def got(docs, **more):
    return sorted(tuple(r) for r in collocations.collocations(docs, **more).collect())


def texts(seed, n):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(30)] + ["É", "ß", "don't", "a b", "x\x1cy"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append(rng.choice(["New York City", "of the", "the the the", "a b c d e", rng.choice(words)]))
            parts.append(rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\r\n", "! "]))
        rows.append(("".join(parts), rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_phrases_of_small_and_large_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "BITMAP_BITS", 1 << 15)
    monkeypatch.setattr(collocations, "ROWS", chunk)
    rows = texts(1, 150) + [(None, "en"), ("", None), (" \n", "fr"), ("z " * 3000, "fr"), ("z " * 3000, "fr"), ("one. two", "es")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert got(docs, support=30, best=2000) == by_hand(rows, 30, 2000)


def test_best_of_each_language_and_ties(spark):
    # Equal scores and counts: phrases in the order of their bytes.
    rows = [(f"{a} {b}.", "en") for a, b in [("é", "b"), ("a", "z"), ("A", "y"), ("q", "r")] for _ in range(3)] + [("k l", None)] * 4
    docs = spark.createDataFrame(rows, DOCS)
    assert got(docs, support=3, best=2) == by_hand(rows, 3, 2)


def test_bits_that_are_shared_by_phrases_change_nothing(spark, monkeypatch):
    rows = texts(4, 60)
    monkeypatch.setattr(collocations, "BITMAP_BITS", 1 << 3)
    docs = spark.createDataFrame(rows, DOCS)
    assert got(docs, support=10, best=50) == by_hand(rows, 10, 50)


def test_empty_tables_and_other_columns(spark):
    assert got(spark.createDataFrame([], DOCS)) == []
    docs = spark.createDataFrame([("a b", 7, 1)] * 30, "text string, lang int, n int")
    assert got(docs) == [("7", 1, "a b", 30, 30, 30, 60, 1_000_000)]
