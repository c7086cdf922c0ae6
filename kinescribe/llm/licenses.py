"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

A match has at least ``COVERAGE`` of a template's words, so it misses at most e of its n, and places in it move by at most ``BAND``. So at
most e + ``BAND`` changes cut its other words into runs, and the longest run has at least (n - e) / (e + ``BAND`` + 1) words: the
template's ``span``. The template is winnowed with k-grams of k = span / 2 + 1 words (the smallest hash of every ``span``
words in a row is kept), which leaves at least one fingerprint in that run, in the template as in the text, whatever lies around it.
Short templates have spans of one word, whose winnowing keeps every word. The fingerprints make an inverted index of
hashes to template and place, shared with all tasks; its size is checked (``MOST_WORDS``). Texts are winnowed for each span of
the index and looked up. A hit gives a diagonal (place in the text less place in the template). Template words with an equal
word within ``BAND`` diagonals of it bound the matches there; if the bound reaches ``COVERAGE``, the template is aligned with the
text: a dynamic program over a band of ``BAND`` diagonals on both sides finds the most words that match in order, ties
going to the shortest span. Of overlapping alignments the one with most matches is reported. So no match is missed whose
diagonals lie within ``BAND`` of each other, wherever its words are changed; one with more inserted words inside can be.

All work on a text is done where the text is read: no shuffle, and a text's candidates are bounded by its words.

Edge cases: null and wordless texts and templates match nothing. A very long text is scanned whole, as a slice of its own. Equal templates are reported each. Rows with equal ids are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinescribe.llm.license_texts import TEXTS
from kinescribe.llm.word_hashes import Slice, slices

BAND = 8
COVERAGE = 0.8
#: Words of all templates together.
MOST_WORDS = 1 << 20

#: Short public license notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: What is scanned for unless a user passes templates.
TEMPLATES = {**NOTICES, **TEXTS}


@dataclass(frozen=True)
class Index:
    """Names, word hashes and spans of the templates; for each span the sorted fingerprints with their template and place."""

    names: list[str]
    words: list[np.ndarray]
    prints: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def span_of(n: int, coverage: float) -> int:
    """Words in a row that every match of a template of ``n`` words shares with it."""
    missed = sum(n - e >= coverage * n for e in range(1, n + 1))
    return max(1, -(-(n - missed) // (missed + BAND + 1)))


def _prints(piece: Slice, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed fingerprints for a span."""
    return piece.kept(span // 2 + 1, span)


def build_index(templates: dict[str, str], coverage: float = COVERAGE) -> Index:
    """Inverted index of templates (name to text), for matches of at least ``coverage``."""
    names = sorted(templates)
    words: list[np.ndarray] = []
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for t, name in enumerate(names):
        piece = Slice([(templates[name] or "").encode()])
        words.append(piece.hash)
        span = span_of(len(piece.hash), coverage)
        places, hashes = _prints(piece, span)
        found.setdefault(span, []).append((hashes, np.full(len(places), t), places))
    if sum(map(len, words)) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    prints = {}
    for span, columns in found.items():
        hashes, template, place = (np.concatenate(c) for c in zip(*columns))
        order = np.argsort(hashes, kind="stable")
        prints[span] = hashes[order], template[order], place[order]
    return Index(names, words, prints)


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matches, first word, end) of the best alignment of all of ``template`` within the band around ``diagonal`` in ``text``.

    Only places of the text with ``abs(text place - template place - diagonal) <= band`` are compared. The columns of the
    program are the offsets in the band; of equal numbers of matches, the earliest end, then the latest start is taken.
    """
    width = 2 * band + 1
    score, start, end = [0] * width, [-1] * width, [-1] * width
    n = len(text)
    for i, word in enumerate(template.tolist()):
        base = i + diagonal - band
        # From row to row the band moves by one word: the same column is a diagonal step, the next one skips a template word.
        new, new_start, new_end = score[:], start[:], end[:]
        for c in range(width):
            j = base + c
            if 0 <= j < n and text[j] == word:
                first = start[c] if score[c] else j
                new[c], new_start[c], new_end[c] = score[c] + 1, first, j + 1
            if c + 1 < width and (score[c + 1], -end[c + 1], start[c + 1]) > (new[c], -new_end[c], new_start[c]):
                new[c], new_start[c], new_end[c] = score[c + 1], start[c + 1], end[c + 1]
            if c and (new[c - 1], -new_end[c - 1], new_start[c - 1]) > (new[c], -new_end[c], new_start[c]):
                new[c], new_start[c], new_end[c] = new[c - 1], new_start[c - 1], new_end[c - 1]
        score, start, end = new, new_start, new_end
    best = max(range(width), key=lambda c: (score[c], -end[c], start[c]))
    return score[best], start[best], end[best]


def _met(hashes: np.ndarray, places: np.ndarray, prints: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the slice, template, place in the template) of equal fingerprints."""
    known, template, place = prints
    low = np.searchsorted(known, hashes, "left")
    size = np.searchsorted(known, hashes, "right") - low
    hit = np.flatnonzero(size)
    low, size = low[hit], size[hit]
    at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    return np.repeat(places[hit], size), template[at], place[at]


def _most(piece: Slice, order: np.ndarray, ranked: np.ndarray, template: np.ndarray, text: np.ndarray, diagonal: np.ndarray, band: int = BAND) -> np.ndarray:
    """For each candidate (text of the slice and diagonal in the slice): words of ``template`` that the text has within the band.

    No alignment has more matches. ``ranked`` are the hashes of the slice's words in the order ``order``.
    """
    found = np.zeros(len(diagonal), np.int64)
    first, last = piece.words[text], piece.words[text + 1] - 1
    edges = zip(np.searchsorted(ranked, template, "left").tolist(), np.searchsorted(ranked, template, "right").tolist())
    for place, (a, b) in enumerate(edges):
        if a < b:
            low, high = np.maximum(diagonal + place - band, first), np.minimum(diagonal + place + band, last)
            found += np.searchsorted(order[a:b], low, "left") < np.searchsorted(order[a:b], high, "right")
    return found


def _candidates(index: Index, piece: Slice, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, template, place in the text, place in the template, bound of the matches) of hits that may be matches, in this order."""
    met = [_met(hashes, places, prints) for span, prints in index.prints.items() for places, hashes in [_prints(piece, span)]]
    place, template, t_place = (np.concatenate(c) for c in zip(*met)) if met else (np.zeros(0, np.int64),) * 3
    if not len(place):
        return
    text = np.searchsorted(piece.words, place, "right") - 1
    most = np.zeros(len(place), np.int64)
    order = np.argsort(piece.hash, kind="stable")
    ranked = piece.hash[order]
    for t in np.unique(template).tolist():
        own = np.flatnonzero(template == t)
        pairs, back = np.unique(np.stack([text[own], place[own] - t_place[own]]), axis=1, return_inverse=True)
        most[own] = _most(piece, order, ranked, index.words[t], pairs[0], pairs[1])[back]
    sizes = np.array([len(w) for w in index.words])
    good = most >= coverage * sizes[template]
    columns = [c[good] for c in (text, template, place - piece.words[text], t_place, most)]
    rows = np.lexsort(columns[::-1])
    yield from zip(*(c[rows].tolist() for c in columns))


def scan(texts: list[str | None], index: Index, coverage: float = COVERAGE) -> list[list[dict]]:
    """Matches of each text, ordered by place; matches of one template do not overlap."""
    out: list[list[dict]] = [[] for _ in texts]
    for first, piece in slices(texts):
        of, best, floor, tried = None, (0, 0, 0), 0, set()

        def report() -> None:
            if best[0]:
                words = len(index.words[of[1]])
                out[first + of[0]].append({"template": index.names[of[1]], "matched": best[0], "coverage": best[0] / words, "start": best[1], "end": best[2]})

        for text, template, place, t_place, most in _candidates(index, piece, coverage):
            if of != (text, template):
                report()
                of, best, floor, tried = (text, template), (0, 0, 0), 0, set()
            elif best[0] and place >= best[2]:
                report()
                best, floor, tried = (0, 0, 0), best[2], set()
            diagonal = place - t_place
            if place < floor or diagonal in tried or most <= best[0]:
                continue
            tried.add(diagonal)
            a, b = int(piece.words[text]), int(piece.words[text + 1])
            words = index.words[template]
            low = max(0, diagonal - BAND, floor)
            part = piece.hash[a + low : max(a + low, min(b, a + diagonal + len(words) + BAND))]
            matches, start, end = align(part, words, diagonal - low)
            if matches > best[0] and matches >= coverage * len(words):
                best = matches, low + start, low + end
        report()
    for found in out:
        found.sort(key=lambda m: (m["start"], m["end"], m["template"]))
    return out


_MATCH = T.ArrayType(T.StructType([
    T.StructField("template", T.StringType()), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))
_ARROW = pa.list_(pa.struct([("template", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``licenses``: an array of (template, matched, coverage, start, end), with the span in words of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates, coverage))

    def found(texts: pa.Array) -> pa.Array:
        return pa.array(scan(texts.to_pylist(), shared.value, coverage), _ARROW)

    return docs.drop("licenses").withColumn("licenses", F.arrow_udf(found, _MATCH)(F.col(text).cast("string")))
