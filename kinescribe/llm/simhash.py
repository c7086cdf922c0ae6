"""SimHash near-duplicates, with candidates from pigeonring chains of segments.

A 64-bit fingerprint is cut into a ring of five segments. If two fingerprints differ in at most four bits,
some start on the ring exists from which every chain of 1, 2, 3, 4, 5 segments differs in at most 0.8, 1.6,
2.4, 3.2, 4 bits: the chain budgets are in proportion to the length of the chain. So the first segment is
equal and the second differs in at most one bit. These two make an equi-join key of about 26 bits: one side
has its own key per start, the other also the keys with one bit of the second segment flipped. Pairs must
then keep the budgets of the chains of three and four segments before the full distance is taken.

Rows with equal fingerprints are one node from the start. Near copies can make many links among themselves,
so the join runs twice. First every fingerprint is compared with the smallest one that has the same key, at
most five comparisons each, and the links found give provisional components. The full join then only lets
through pairs of different provisional components. No bucket is cut; a bucket with very many fingerprints is
a skewed join key, which adaptive execution splits.

``drop_similar`` asks for a similarity of word shingles instead of a number of bits. There both joins of the chains tell which documents are compared
first, and whole sets of shingles decide. Sets of similarity 0.8 differ in about 10 of 64 bits, which no chain filter of 64 bits can
select, so bands of minima (``minhash``) supply the pairs that the fingerprints miss.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescribe.llm import minhash
from kinescribe.llm.common import PLACE, lazily, located, shuffled, small_batches, stage, with_place, without
from kinescribe.llm.components import connected_components

BITS = 64
#: Differing bits up to which fingerprints are linked.
DISTANCE = 4
#: Words per shingle.
SHINGLE = 4
SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: words are what white space of ASCII separates, A-Z count as a-z; no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first = (ends - lengths)[: max(1, len(words) - shingle + 1)].tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), BLOCK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big")


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> pa.Array:
    """SimHash of each text; the 64 bits as a signed long."""
    found = [fingerprint_of(t, shingle) for t in lazily(texts)]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def _printer(shingle: int) -> Callable[[pa.Array], pa.Array]:
    def prints(texts: pa.Array) -> pa.Array:
        return fingerprints(texts, shingle)

    return prints


def _segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(segments: list[tuple[int, int]]) -> int:
    """Long with the bits of the segments set."""
    bits = sum(((1 << width) - 1) << low for low, width in segments)
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _differing(a: Column, b: Column, mask: int = -1) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask)))


def _chains(distance: int) -> list[list[tuple[int, int]]]:
    """For each start, the segments in the order of the ring."""
    ring = _segments(distance + 1)
    return [ring[i:] + ring[:i] for i in range(len(ring))]


def _keys(nodes: DataFrame, distance: int, flips: bool) -> DataFrame:
    """A row per start and key: the bits of the first two segments, and with ``flips`` those one bit of the second away."""
    fp = F.col("fp")
    keys = []
    for start, chain in enumerate(_chains(distance)):
        own = fp.bitwiseAND(F.lit(_mask(chain[:2])))
        low, width = chain[1]
        variants = [own] + ([own.bitwiseXOR(F.lit(_mask([(low + b, 1)]))) for b in range(width)] if flips else [])
        keys += [F.struct(F.lit(start).cast("byte").alias("start"), v.alias("key")) for v in variants]
    return nodes.select("*", F.explode(F.array(*keys)).alias("k")).select(*nodes.columns, "k.*")


def _within_budgets(a: Column, b: Column, start: Column, distance: int) -> Column:
    """The chain budgets beyond the key, then the full distance."""
    chains = _chains(distance)
    passed = F.lit(False)
    for i, chain in enumerate(chains):
        ok = F.lit(True)
        for length in range(3, len(chain)):
            ok &= _differing(a, b, _mask(chain[:length])) <= length * distance // len(chain)
        passed |= (start == i) & ok
    return passed & (_differing(a, b) <= distance)


def star_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, low): fingerprints of ``nodes`` that are linked with the smallest one of the same key."""
    plain = _keys(nodes.select("fp"), distance, False)
    smallest = plain.groupBy("start", "key").agg(F.min("fp").alias("low"))
    near = plain.join(shuffled(smallest), ["start", "key"]).where(F.col("fp") != F.col("low"))
    return near.where(_within_budgets(F.col("fp"), F.col("low"), F.col("start"), distance)).select("fp", "low")


def _rough(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """(fp, component) by the links ``stars`` alone."""
    rough = connected_components(stars.select(F.col("fp").alias("a"), F.col("low").alias("b")))
    rough = nodes.select("fp").join(rough, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))
    return stage(rough)


def _bridges(rough: DataFrame, distance: int) -> DataFrame:
    """(fp, low, component, low_component): all linked fingerprints of different components of ``rough``."""
    a, b = _keys(rough, distance, False).alias("a"), shuffled(_keys(rough, distance, True)).alias("b")
    on = (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component"))
    met = a.join(b, on & _within_budgets(F.col("a.fp"), F.col("b.fp"), F.col("a.start"), distance))
    return met.select(F.col("b.fp").alias("fp"), F.col("a.fp").alias("low"), F.col("b.component").alias("component"), F.col("a.component").alias("low_component"))


def chain_pairs(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, low): linked fingerprints of both joins; their components are those of all links."""
    stars = stage(star_pairs(nodes, distance))
    return stars.union(_bridges(_rough(nodes, stars), distance).select("fp", "low")).distinct()


def linked_fingerprints(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component) of distinct fingerprints ``fp``: components of "at most ``distance`` differing bits"."""
    rough = _rough(nodes, star_pairs(nodes, distance))
    bridges = _bridges(rough, distance)
    merged = connected_components(bridges.select(F.col("low_component").alias("a"), F.col("component").alias("b")))
    joined = rough.join(merged, rough["component"] == F.col("node"), "left")
    return joined.select("fp", F.coalesce(merged["component"], rough["component"]).alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (long), ``component_id``, and the columns ``carry``.

    ``component_id`` is the smallest id that can be reached over links, the document's own included. A null
    or blank text has fingerprint 0 and is linked like any other. Repeated rows stay repeated. A document
    without an id links others but never names a component, unless no member has an id: then it is null.
    """
    return _classes(docs, doc_id, text, distance, carry).drop("_component")


def _classes(docs: DataFrame, doc_id: str, text: str, distance: int, carry: Sequence[str]) -> DataFrame:
    """As above, with the smallest fingerprint of the component as ``_component``."""
    small_batches(docs.sparkSession)
    marked = docs.select(F.col(doc_id).alias("_id"), F.arrow_udf(_printer(SHINGLE), "long")(F.col(text).cast("string")).alias("fp"), *carry)
    marked = stage(marked)
    nodes = stage(marked.groupBy("fp").agg(F.min("_id").alias("first_id")))
    classes = stage(linked_fingerprints(nodes, distance))
    names = nodes.join(classes, "fp").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(names, "component").select("fp", "component_id", F.col("component").alias("_component"))
    return marked.join(named, "fp").select(F.col("_id").alias(doc_id), F.col("fp").alias("fingerprint"), "component_id", *carry, "_component")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, of several the first by place."""
    docs = located(docs)
    rows = stage(_classes(with_place(docs), doc_id, text, distance, PLACE).select(F.col(doc_id).alias("id"), "_component", *PLACE))
    best = rows.groupBy("_component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *PLACE)).alias("k"))
    return without(docs, rows.join(best.select("k." + PLACE[0], "k." + PLACE[1]), PLACE, "left_anti"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component of "sets of word shingles are similar": the smallest id, of several the first by place.

    Null and blank texts are copies of each other.
    """
    docs = located(docs)
    prints = F.arrow_udf(_printer(shingle), "long")(F.col(text).cast("string"))
    rows, nodes = minhash.sketched(docs, text, shingle, F.col(doc_id).alias("id"), prints.alias("fp"))
    marked = rows.where("size > 0").groupBy("node").agg(F.first("fp").alias("fp"))
    firsts = marked.groupBy("fp").agg(F.min("node").alias("centre"))
    marked, firsts = stage(marked), stage(firsts)
    equal = marked.join(firsts, "fp").where("node <> centre").select("node", "centre")
    near = chain_pairs(firsts, distance).join(firsts.withColumnRenamed("centre", "node"), "fp")
    near = near.join(firsts.withColumnRenamed("fp", "low"), "low").select("node", "centre")
    classes = minhash.linked_sets(nodes, docs, text, shingle, similarity, equal.union(near))
    blank = rows.where("size = 0").select("node", F.col("node").alias("component")).distinct()
    return minhash.first_of_each(docs, rows, stage(classes.union(blank)))
