"""Toxicity by weak supervision.

1. Terms. In the labelled rows, words and their beginnings (4 and 6 bytes) are counted by label, once per row. Terms that
   are toxic with confidence (lower bound of the share of toxic rows) form lexicons, strong and weak ones for each kind.
2. Voters. Each lexicon votes if a text has one of its terms, and again if it has two; patterns vote on insults addressed
   to somebody, masked letters and shouting. A text's votes are the bits of one number below 2^VOTERS, so all votes of a
   corpus are a table of at most 3 x 2^VOTERS counts (by label: toxic, clean, unknown).
3. Label model. A generative model has a class prior and, for each class, a tree over the voters: every voter depends on
   the class and on one other voter (the maximum spanning tree of conditional mutual information). Its tables are the
   accuracies and the correlations of the voters. It is fitted by EM to labelled and unlabelled rows; known labels stay.
4. Classifier. Logistic regression on hashed terms and votes learns posterior labels only. That of an unlabelled row is the label
   model's for its votes; that of a labelled row has the given label as one more voter, independent of the others and right with
   probability ``LABEL_TRUST``. The sample has at most ``FIT_ROWS`` rows of the training fold: a share ``UNTOLD`` of them is
   for unlabelled rows, the rest for labelled ones, both drawn by a hash of the row's id and place, so copies of a text are drawn
   one by one. Unlabelled rows together weigh ``UNTOLD`` of the loss, however many there are. It scores whole texts.

Tables that grow with the data are counted in tasks and summed by shuffles; the driver gets a bitmap of ``TERM_BUCKETS`` bits per lexicon,
the table of votes and the sample. The sample's features (at most FEATURES + VOTERS a row) are streamed into a temporary file of the driver
and read in blocks of ``FIT_BLOCK`` numbers. Bitmaps, the keys of the sample and the weights are broadcast.

Edge cases: a null or wordless text has no terms and is scored by the classifier's constant. A very long text is read whole. Labels other than 0 and 1 and rows without a
text teach nothing; of several labels of one row the highest counts. Without labels there are no lexicons, and without
any training row every score is ``PRIOR``. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import PLACE, located, maybe_in, stage, with_place
from kinescribe.llm.word_hashes import Slice, slices

#: Kinds of terms: whole words, and words cut after so many bytes.
KINDS = (0, 4, 6)
#: Hash buckets of terms when they are counted, and of the classifier's features.
TERM_BUCKETS, FEATURES = 1 << 22, 1 << 18
STRONG, WEAK = 0.75, 0.35
FIT_ROWS = 1 << 14
#: Share of unlabelled rows in the sample's limit and in the loss.
UNTOLD = 0.25
#: Probability with which a given label is right.
LABEL_TRUST = 0.95
#: Features of the sample that are read at a time; a row has no more than this.
FIT_BLOCK = 1 << 17
PRIOR = 0.1
EM_ROUNDS, FIT_ROUNDS = 50, 300
#: Weight of the squared weights in the classifier's loss.
PULL = 1e-5

#: English insults that are common knowledge, addressed to a person.
_ADDRESSED = re.compile(r"\b(?:you|u|ur|your|he|she|they)\b[^.!?\n]{0,30}\b(?:idiots?|morons?|stupid|losers?|scum|trash|pathetic|worthless|disgusting|clowns?|dumb|fools?)\b", re.I)
_MASKED = re.compile(r"\b[a-zA-Z]+[*@#$]{2,}[a-zA-Z]*\b")
_SHOUTED = re.compile(r"[A-Z]{4,}[^a-z\n]{0,40}[A-Z]{4,}|!{3,}")
PATTERNS = (_ADDRESSED, _MASKED, _SHOUTED)
VOTERS = 3 * len(KINDS) + len(PATTERNS)


@dataclass(frozen=True)
class ToxicityModel:
    """Bitmaps of strong and weak terms per kind, and the classifier's weights (terms, then votes) and constant."""

    strong: list[np.ndarray]
    weak: list[np.ndarray]
    weights: np.ndarray
    constant: float


def _terms(piece: Slice) -> Iterator[np.ndarray]:
    """Hash of every word's term, for each kind."""
    for kind in KINDS:
        yield (piece.hash if kind == 0 else piece.prefix(kind)) ^ np.uint64(0x9E3779B97F4A7C15 * (kind + 1) % (1 << 64))


def _distinct(owner: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, bucket), each once, ordered by text."""
    pairs = np.unique((owner.astype(np.uint64) << np.uint64(32)) | buckets)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _owners(piece: Slice) -> np.ndarray:
    return np.repeat(np.arange(len(piece.words) - 1), np.diff(piece.words))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, rows with it that are toxic, and clean); bucket -1 counts the rows."""
    counts = np.zeros((len(KINDS), 2, TERM_BUCKETS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        rows += np.bincount(labels, minlength=2)
        for first, piece in slices(batch.column(0).to_pylist()):
            owner = _owners(piece)
            for k, hashes in enumerate(_terms(piece)):
                text, bucket = _distinct(owner, hashes & np.uint64(TERM_BUCKETS - 1))
                np.add.at(counts[k], (labels[first + text], bucket), 1)
    for k in range(len(KINDS)):
        seen = np.flatnonzero(counts[k].any(axis=0))
        for at in range(0, len(seen), 1 << 16):
            part = seen[at : at + (1 << 16)]
            yield pa.record_batch([pa.array(np.full(len(part), k, np.int32)), pa.array(part.astype(np.int32)), pa.array(counts[k, 1, part].astype(np.int64)), pa.array(counts[k, 0, part].astype(np.int64))], ["kind", "bucket", "toxic", "clean"])
    yield pa.record_batch([pa.array([0], pa.int32()), pa.array([-1], pa.int32()), pa.array(rows[1:]), pa.array(rows[:1])], ["kind", "bucket", "toxic", "clean"])


def _lexicons(labelled: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Strong and weak terms of each kind from (text, toxic)."""
    counted = labelled.mapInArrow(_count_terms, "kind int, bucket int, toxic long, clean long").where("bucket >= 0")
    counted = counted.groupBy("kind", "bucket").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    n, share = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    z = 1.64
    # Wilson's lower bound of the share.
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = stage(counted.withColumn("low", low).where((F.col("low") >= WEAK) & (F.col("t") >= 3)).select("kind", "bucket", "low"))
    # These functions count from 1.
    at = F.col("bucket") + 1
    bits = good.groupBy("kind", (F.col("low") >= STRONG).alias("strong"), F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    strong, weak = ([np.zeros(TERM_BUCKETS // 8, np.uint8) for _ in KINDS] for _ in range(2))
    for row in bits.toLocalIterator():
        part = np.frombuffer(bytes(row.bits), np.uint8)
        (strong if row.strong else weak)[row.kind][(row.part - 1) * len(part) : row.part * len(part)] = part
    return strong, weak


def _in(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (bitmap[values >> np.uint64(3)] >> (values & np.uint64(7)).astype(np.uint8)) & 1 == 1


def votes_of(texts: list[str | None], strong: list[np.ndarray], weak: list[np.ndarray]) -> np.ndarray:
    """Votes of each text, as the bits of a number."""
    votes = np.zeros(len(texts), np.int64)
    for first, piece in slices(texts):
        owner = _owners(piece)
        n = len(piece.words) - 1
        for k, hashes in enumerate(_terms(piece)):
            terms = hashes & np.uint64(TERM_BUCKETS - 1)
            sure, maybe = _in(strong[k], terms), _in(weak[k], terms)
            hits = sure | maybe
            several = np.bincount(_distinct(owner[hits], terms[hits])[0], minlength=n) > 1
            for bit, found in enumerate((np.bincount(owner[sure], minlength=n) > 0, np.bincount(owner[maybe], minlength=n) > 0, several)):
                votes[first : first + n] |= found.astype(np.int64) << (3 * k + bit)
    for p, pattern in enumerate(PATTERNS):
        found = np.fromiter((bool(t and pattern.search(t)) for t in texts), bool, len(texts))
        votes |= found.astype(np.int64) << (3 * len(KINDS) + p)
    return votes


def _bits(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS)) & 1


def _tree(bits: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """(voter, the voter it depends on or -1), parents first: the spanning tree of most mutual information given the class."""
    gain = np.zeros((VOTERS, VOTERS))
    for c in range(2):
        w = weight[:, c]
        total = w.sum() + 1.0
        one = (w @ bits + 0.5) / total
        both = (bits.T * w) @ bits / total
        for a, b, joint in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one[None, :] - both), (1 - one, 1 - one, 1 - one[:, None] - one[None, :] + both)):
            joint = np.clip(joint, 1e-9, None)
            gain += total * joint * np.log(joint / np.outer(a, b))
    edges, left = [(0, -1)], set(range(1, VOTERS))
    while left:
        inside = [v for v, _ in edges]
        v, p = max(((v, p) for v in sorted(left) for p in inside), key=lambda e: gain[e])
        edges.append((v, p))
        left.remove(v)
    return edges


def label_model(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of the toxic class for each row of ``patterns``; ``counts`` has columns (clean, toxic, unknown)."""
    bits = _bits(patterns)
    known = counts[:, :2].astype(float)
    # The start: what the labels say about the pattern, else one vote in four voters.
    guess = (known[:, 1] + 2 * np.clip(bits.mean(axis=1) * 4, 0.02, 0.98)) / (known.sum(axis=1) + 2)
    for _ in range(EM_ROUNDS):
        weight = known + counts[:, 2:] * np.stack([1 - guess, guess], axis=1)
        logs = np.log(weight.sum(axis=0) + 1.0)[None, :].repeat(len(patterns), axis=0)
        for v, p in _tree(bits, weight):
            for c in range(2):
                w = weight[:, c]
                for state in (0, 1):
                    at = bits[:, p] == state if p >= 0 else np.full(len(bits), state == 0)
                    rate = ((w * at) @ bits[:, v] + 0.1) / ((w * at).sum() + 1.0)
                    logs[at, c] += np.log(np.where(bits[at, v] == 1, rate, 1 - rate))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if np.abs(new - guess).max() < 1e-6:
            break
        guess = new
    return guess


def _features(texts: list[str | None], votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each pair once, ordered by text: hashed terms, then votes behind them."""
    owners, features = [], []
    for first, piece in slices(texts):
        owner = _owners(piece)
        terms = list(_terms(piece))
        text, bucket = _distinct(np.tile(owner, len(terms)), np.concatenate(terms) >> np.uint64(20) & np.uint64(FEATURES - 1))
        owners.append(first + text)
        features.append(bucket)
    text, voter = np.nonzero(_bits(votes))
    owner = np.concatenate([*owners, text]).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate([*features, FEATURES + voter]).astype(np.int64)[order]


def _values(owner: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
    """Value of each feature: terms have the length 1 together in each text, votes count in full."""
    term = features < FEATURES
    size = np.maximum(np.bincount(owner[term], minlength=n), 1)
    return np.where(term, 1 / np.sqrt(size)[owner], 1.0)


def _blocks(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive rows with at most FIT_BLOCK features together."""
    ends, blocks, first = np.cumsum(lengths), [], 0
    while first < len(lengths):
        done = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, done + FIT_BLOCK, "right")))
        blocks.append((first, end))
        first = end
    return blocks


def given(posterior: np.ndarray, toxic: int | None) -> np.ndarray:
    """``posterior`` after a label (or none), as the vote of one more voter that is right with probability ``LABEL_TRUST``."""
    if toxic is None:
        return posterior
    yes, no = (LABEL_TRUST, 1 - LABEL_TRUST) if toxic else (1 - LABEL_TRUST, LABEL_TRUST)
    return yes * posterior / (yes * posterior + no * (1 - posterior))


def shares(told: np.ndarray) -> np.ndarray:
    """Weight of each row of the sample: unlabelled rows have ``UNTOLD`` together, labelled ones the rest; all together 1."""
    weight = np.where(told, (1 - UNTOLD) / max(told.sum(), 1), UNTOLD / max((~told).sum(), 1))
    return weight / weight.sum()


def _fit(features: BinaryIO, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a pull towards 0, by accelerated gradient descent; ``features`` holds those of all rows as 32-bit numbers."""
    n = len(target)
    blocks = _blocks(lengths)

    def parts() -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, sizes, ends, features) of each block."""
        features.seek(0)
        for first, end in blocks:
            size = lengths[first:end]
            yield slice(first, end), size, np.cumsum(size), np.frombuffer(features.read(4 * int(size.sum())), "<u4").astype(np.int64)

    def per_row(values: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[ends] - sums[ends - size]

    # Value of a term in each row, as in _values; votes count in full.
    scale = np.concatenate([1 / np.sqrt(np.maximum(per_row(part < FEATURES, size, ends), 1)) for _, size, ends, part in parts()])
    # The slope changes by at most a quarter of the squared length of a row: terms 1, constant 1, votes.
    step = 4.0 / (2 + VOTERS)
    at = np.zeros(FEATURES + VOTERS + 1)
    toxic = n * (weight @ target)
    at[-1] = np.log((toxic + PRIOR) / (n - toxic + 1 - PRIOR))
    before = at
    for k in range(1, FIT_ROUNDS + 1):
        ahead = at + (k - 1) / (k + 2) * (at - before)
        slope = PULL * ahead
        slope[-1] = 0.0
        for rows, size, ends, part in parts():
            values = np.repeat(scale[rows], size)
            values[part >= FEATURES] = 1.0
            z = per_row(ahead[part] * values, size, ends) + ahead[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[rows]) * weight[rows]
            slope[:-1] += np.bincount(part, weights=np.repeat(error, size) * values, minlength=len(at) - 1)
            slope[-1] += error.sum()
        before, at = at, ahead - step * slope
    return at[:-1], float(at[-1])


def fit_sample(rows: DataFrame, known: DataFrame, size: int | None = None) -> DataFrame:
    """Places and hashes of at most ``size`` (``FIT_ROWS``) of ``rows`` (doc_id and place): the first labelled and the first unlabelled ones by the hash."""
    size = FIT_ROWS if size is None else size
    keyed = rows.select("doc_id", *PLACE).join(known.select("doc_id", F.lit(1).alias("told")), "doc_id", "left")
    keyed = keyed.withColumn("h", F.xxhash64("doc_id", PLACE[1]))
    untold = int(size * UNTOLD)
    parts = [keyed.where(which).orderBy("h", "doc_id", *PLACE).limit(n) for which, n in (("told = 1", size - untold), ("told IS NULL", untold))]
    return parts[0].union(parts[1]).select(*PLACE, "h")


def train_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """Model from all rows of ``docs`` (the training fold), of which ``labels`` covers some."""
    rows = with_place(located(docs)).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *PLACE).where("text IS NOT NULL")
    known = labels.where(F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(toxic).cast("int").alias("toxic"))
    known = stage(known)
    labelled = maybe_in(rows, known, "doc_id").join(known, "doc_id").select("text", "toxic")
    strong, weak = _lexicons(labelled)

    def vote(texts: pa.Array, sampled: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        votes = votes_of(values, strong, weak)
        chosen = np.flatnonzero(sampled.to_numpy(zero_copy_only=False))
        owner, features = _features([values[i] for i in chosen.tolist()], votes[chosen])
        edges = np.searchsorted(owner, np.arange(len(chosen) + 1))
        found: list[bytes | None] = [None] * len(values)
        for i, a, b in zip(chosen.tolist(), edges.tolist(), edges[1:].tolist()):
            found[i] = features[a:b].astype("<u4").tobytes()
        return pa.StructArray.from_arrays([pa.array(votes), pa.array(found, pa.binary())], ["votes", "features"])

    # At most FIT_ROWS keys.
    sample = stage(fit_sample(rows, known))
    marked = rows.join(F.broadcast(sample), PLACE, "left")
    voted = stage(marked.select("doc_id", "h", F.arrow_udf(vote, "votes long, features binary")("text", F.col("h").isNotNull()).alias("v")).select("doc_id", "h", "v.*"))
    told = voted.select("doc_id", "votes").join(known, "doc_id", "left").groupBy("votes").agg(
        *[F.count(F.when(F.col("toxic") == c, 1)).alias(f"n{c}") for c in (0, 1)], F.count(F.when(F.col("toxic").isNull(), 1)).alias("n2")
    ).orderBy("votes").toPandas()
    if not len(told):
        return ToxicityModel(strong, weak, np.zeros(FEATURES + VOTERS), float(np.log(PRIOR / (1 - PRIOR))))
    patterns, counts = told["votes"].to_numpy(np.int64), told[["n0", "n1", "n2"]].to_numpy(float)
    posterior = label_model(patterns, counts)

    chosen = voted.where("features IS NOT NULL").join(known, "doc_id", "left").orderBy("h", "doc_id").select("features", "toxic", "votes")
    lengths, target, told_rows = [], [], []
    with tempfile.TemporaryFile() as file:
        for row in chosen.toLocalIterator():
            file.write(row.features)
            lengths.append(len(row.features) // 4)
            target.append(given(posterior[np.searchsorted(patterns, row.votes)], row.toxic))
            told_rows.append(row.toxic is not None)
        weights, constant = _fit(file, np.array(lengths, np.int64), np.array(target, float), shares(np.array(told_rows, bool)))
    return ToxicityModel(strong, weak, weights.astype(np.float32), constant)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); columns of that name are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        m, values = shared.value, texts.to_pylist()
        owner, features = _features(values, votes_of(values, m.strong, m.weak))
        z = np.bincount(owner, weights=m.weights[features] * _values(owner, features, len(values)), minlength=len(values)) + m.constant
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    plain = docs.drop("score", "predicted")
    scored = plain.withColumn("score", F.arrow_udf(score, "double")(F.col(text).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
