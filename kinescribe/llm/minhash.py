"""MinHash near-duplicates: documents whose sets of word shingles have at least a given Jaccard similarity.

1. Sketch. ``BANDS`` x ``ROWS`` universal hashes (multiply and add modulo 2^32) of a set's shingles are minimised and cut into bands.
   Sets of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9990 at 0.8, 0.99999 at 0.85, 0.4 at 0.6, 0.02 at 0.4.
2. Stars. Of every band's bucket, each set is compared with the smallest one. All comparisons are of whole sets of shingles.
   The links found give provisional components.
3. Rest. Buckets that still hold several components tie those into clusters. A cluster is cut into blocks of about ``BLOCK``
   shingles; the components that fit into a block stay together, larger ones are dealt over blocks of their own. Every two blocks
   that are not of one component meet in a task, which compares the sets that share a band and belong to different components,
   and returns at most one link for every two components. So no pairs are emitted, a task holds two blocks whatever the size of
   the group, and no bucket is cut.
4. Components of all links, by alternating large-star and small-star steps.

Edge cases: words are what white space of ASCII separates, A-Z count as a-z. A text of fewer words than a shingle has one shingle of all
its words; a null or blank text has none and is linked with nothing. Documents with equal sets are one node from the start, so copies
and repeated rows cost nothing. Shingles are compared by 64-bit hashes. Other columns may have any names. A very long text is one set
in one block. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import PLACE, batches, lazily, located, maybe_in, shuffled, stage, with_place, without
from kinescribe.llm.components import connected_components
from kinescribe.llm.word_hashes import mixed

SHINGLE = 2
#: Least similarity of a link, as a fraction.
SIMILARITY = (80, 100)
BANDS, ROWS = 48, 9
#: Shingles that are hashed at a time.
AT_ONCE = 128
#: Shingles of all sets of a block together, about; two blocks meet in a task.
BLOCK = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _hashes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and summands of the universal hashes, and room for their values."""
    rng = np.random.default_rng(42)
    factors, summands = rng.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
    return factors | np.uint32(1), summands, np.empty((AT_ONCE, BANDS * ROWS), np.uint32)


def shingles_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((known.get(w) or known.setdefault(w, digest(w)) for w in words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * _P + hashes[k : k + n]
    return np.unique(mixed(h))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """Hash of each band of minima."""
    factors, summands, room = _hashes()
    halves = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(halves), AT_ONCE):
        part = halves[at : at + AT_ONCE, None]
        values = room[: len(part)]
        np.multiply(part, factors, out=values)
        np.add(values, summands, out=values)
        np.minimum(low, values.min(axis=0), out=low)
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in low.reshape(BANDS, ROWS).T:
        h = mixed(h * _P + column)
    return h


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def _sketcher(shingle: int) -> Callable[[pa.Array], pa.Array]:
    def sketches(texts: pa.Array) -> pa.Array:
        nodes, sizes, bands = [], [], []
        for text in lazily(texts):
            found = shingles_of(text, shingle)
            nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
            sizes.append(len(found))
            bands.append(bands_of(found) if len(found) else np.zeros(0, np.uint64))
        columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _lists(bands)]
        return pa.StructArray.from_arrays(columns, ["node", "size", "bands"])

    return sketches


def _set_maker(shingle: int) -> Callable[[pa.Array], pa.Array]:
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles_of(t, shingle).tobytes() for t in lazily(texts)], pa.binary())

    return sets


class _Sets:
    """Sets of shingles of a task, to be counted against one of them at a time."""

    def __init__(self, column: pa.ChunkedArray):
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in column.combine_chunks()]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.cumsum(self.size) - self.size
        known, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self._marked = np.zeros(len(known), np.int32)

    def shared(self, row: int, others: np.ndarray) -> np.ndarray:
        """Shingles that each of ``others`` shares with ``row``."""
        own = self.ids[self.first[row] : self.first[row] + self.size[row]]
        self._marked[own] = 1
        size = self.size[others]
        start = np.cumsum(size) - size
        at = np.repeat(self.first[others] - start, size) + np.arange(size.sum())
        found = np.add.reduceat(self._marked[self.ids[at]], start)
        self._marked[own] = 0
        return found


def _buckets(bands: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows ordered by bucket, first and end place of the bucket of each row and band)."""
    flat = bands.combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    _, bucket = np.unique(flat, return_inverse=True)
    bucket = bucket.reshape(-1)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket))
    end = ends[bucket].reshape(flat.shape)
    return order // BANDS, np.concatenate([[0], ends])[bucket].reshape(flat.shape), end


def _comparer(similarity: tuple[int, int], star: bool) -> Callable[[pa.Table], pa.Table]:
    """Function from the rows of a task (side, node, component, bands, shingles) to links (a, b) between components.

    Rows of side 0 are compared with those of side 1, rows of side 2 with each other; only those that share a band, unless
    ``star`` is set. Once two components are linked, they count as one.
    """
    num, den = similarity

    def links(rows: pa.Table) -> pa.Table:
        side, component = rows["side"].to_numpy(), rows["component"].to_numpy()
        names, place = np.unique(component, return_inverse=True)
        part = place.copy()
        sets = _Sets(rows["shingles"])
        if not star:
            order, first, end = _buckets(rows["bands"])
        found: list[tuple[int, int]] = []
        right = np.flatnonzero(side == 1)
        for row in np.flatnonzero(side != 1).tolist():
            if star:
                others = right
            else:
                others = np.unique(np.concatenate([order[a:b] for a, b in zip(first[row].tolist(), end[row].tolist())]))
                others = others[others > row] if side[row] == 2 else others[side[others] == 1]
            others = others[part[others] != part[row]]
            size, own = sets.size[others], sets.size[row]
            others = others[np.minimum(size, own) * den >= np.maximum(size, own) * num]
            if not len(others):
                continue
            both = sets.shared(row, others)
            for other in others[both * (num + den) >= num * (sets.size[others] + own)].tolist():
                if part[other] != part[row]:
                    found.append((int(names[place[row]]), int(names[place[other]])))
                    part[part == part[other]] = part[row]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return links


def _known(asked: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(node, size, bands, shingles) of the nodes in ``asked``; the sets are made again from the texts."""
    asked = stage(nodes.join(asked, "node", "left_semi").select("node", "size", "bands", "place.*"))
    texts = with_place(docs).select(F.col(text).cast("string").alias("text"), *PLACE, F.xxhash64(*PLACE).alias("_at"))
    texts = maybe_in(texts, asked.select(F.xxhash64(*PLACE).alias("_at")), "_at").drop("_at").join(asked, PLACE)
    with batches(docs.sparkSession):
        return stage(texts.select("node", "size", "bands", F.arrow_udf(_set_maker(shingle), "binary")("text").alias("shingles")))


def _stars(pairs: DataFrame, known: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) among ``pairs`` (node, centre): a centre and about BLOCK shingles of its partners per task."""
    pairs = pairs.join(known.select("node", "size"), "node")
    parts = pairs.groupBy("centre").agg(F.ceil(F.sum("size") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
    members = stage(pairs.join(parts, "centre").select("node", "centre", part.alias("part")))
    rows = members.select("centre", "part", F.lit(1).alias("side"), "node").union(
        members.select("centre", "part").distinct().select("centre", "part", F.lit(0).alias("side"), F.col("centre").alias("node"))
    )
    rows = rows.join(known, "node").select("centre", "part", "side", F.col("node").alias("component"), F.lit(None).cast("array<long>").alias("bands"), "shingles")
    return rows.groupBy("centre", "part").applyInArrow(_comparer(similarity, True), "a long, b long")


def _met(members: DataFrame, known: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between the components of ``members`` (cluster, component, node, size), by blocks."""
    whole = members.groupBy("cluster", "component").agg(F.sum("size").alias("weight"))
    whole = whole.withColumn("own", F.when(F.col("weight") > BLOCK, F.col("component")))
    room = whole.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("own").isNull(), F.col("weight"))) / BLOCK)).alias("shared"))
    whole = whole.join(room, "cluster").withColumn("parts", F.when(F.col("own").isNull(), F.col("shared")).otherwise(F.ceil(F.col("weight") / BLOCK)))
    part = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("component")).otherwise(F.col("node")), F.lit(1)), F.col("parts"))
    dealt = members.join(whole.drop("weight", "shared"), ["cluster", "component"]).withColumn("block", F.struct(F.col("own").isNull().alias("mixed"), "own", part.alias("part")))
    dealt = stage(dealt.select("cluster", "component", "node", "block"))
    blocks = dealt.select("cluster", "block").distinct()
    a, b = blocks.alias("a"), blocks.select("cluster", F.col("block").alias("other")).alias("b")
    cells = a.join(b, "cluster").where((F.col("block") < F.col("other")) & (F.col("block.mixed") | (F.col("block.own") != F.col("other.own")) | F.col("other.mixed")))
    alone = blocks.where("block.mixed").select("cluster", F.col("block").alias("left"), F.col("block").alias("right"), F.lit(2).alias("side"), "block")
    pairs = cells.select("cluster", F.col("block").alias("left"), F.col("other").alias("right"))
    cells = pairs.select("*", F.lit(0).alias("side"), F.col("left").alias("block")).union(pairs.select("*", F.lit(1).alias("side"), F.col("right").alias("block"))).union(alone)
    rows = stage(dealt.join(stage(cells), ["cluster", "block"]).select("cluster", "left", "right", "side", "component", "node"))
    rows = rows.join(known, "node").select(F.struct("cluster", "left", "right").alias("cell"), "side", "component", "bands", "shingles")
    return rows.groupBy("cell").applyInArrow(_comparer(similarity, False), "a long, b long")


def _fit(a: Column, b: Column, similarity: tuple[int, int]) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * similarity[1] >= F.greatest(a, b) * similarity[0]


def _named(names: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, component) after the components of ``names`` have been joined as in ``merged`` (node, component)."""
    joined = names.join(merged.toDF("component", "merged"), "component", "left")
    return joined.select("node", F.coalesce("merged", "component").alias("component"))


def _shared(nodes: DataFrame) -> DataFrame:
    """(key, node, size, low, low_size): the bands that several nodes have, and the smallest node of each."""
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min(F.struct("node", "size")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(shuffled(buckets), "key").select("key", "node", "size", F.col("low.node").alias("low"), F.col("low.size").alias("low_size"))


def linked_sets(nodes: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: tuple[int, int], pairs: DataFrame | None = None) -> DataFrame:
    """(node, component) of ``nodes`` (node, size, bands, place of a text); ``pairs`` (node, centre) are compared as well."""
    shared = stage(_shared(nodes))
    near = shared.where((F.col("node") != F.col("low")) & _fit(F.col("size"), F.col("low_size"), similarity)).select("node", F.col("low").alias("centre"))
    near = near if pairs is None else near.union(pairs.select("node", "centre"))
    near = stage(near.distinct())
    known = _known(shared.select("node").union(near.select("node")).union(near.select("centre")).distinct(), nodes, docs, text, shingle)
    rough = connected_components(_stars(near, known, similarity))
    names = stage(nodes.select("node").join(rough, "node", "left").select("node", F.coalesce("component", "node").alias("component")))

    held = stage(shared.select("key", "node", "size").join(names, "node"))
    several = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").drop("high")
    held = stage(held.join(stage(several), "key").select("node", "size", "component", "low"))
    if held.isEmpty():
        return names
    clusters = connected_components(held.select(F.col("component").alias("a"), F.col("low").alias("b")))
    members = held.select("node", "size", "component").distinct().join(clusters.toDF("component", "cluster"), "component")
    return _named(names, connected_components(_met(stage(members), known, similarity)))


def sketched(docs: DataFrame, text: str, shingle: int, *carry: str | Column) -> tuple[DataFrame, DataFrame]:
    """Rows (carried columns, place, node, size) of a scan of files, and nodes (node, size, bands, place of a text)."""
    sketch = F.arrow_udf(_sketcher(shingle), "node long, size long, bands array<long>")(F.col(text).cast("string"))
    with batches(docs.sparkSession):
        rows = stage(with_place(docs).select(*carry, *PLACE, sketch.alias("s")).select("*", "s.*").drop("s"))
    found = rows.where("size > 0").groupBy("node").agg(F.min(F.struct(*PLACE)).alias("place"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    return rows.drop("bands"), stage(found)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, and the columns ``carry``.

    ``component_id`` is the smallest id that can be reached over links, the document's own included; ``kept`` says that it is the
    document's own. A document without an id links others but never names a component, unless no member has an id: then it is null.
    """
    docs = located(docs)
    rows, nodes = sketched(docs, text, shingle, F.col(doc_id).alias("_id"), *carry)
    ids = rows.where("size > 0").groupBy("node").agg(F.min("_id").alias("first_id"))
    classes = stage(linked_sets(nodes, docs, text, shingle, similarity).join(ids, "node"))
    named = classes.join(classes.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("node", "component_id")
    # A row without shingles meets nobody.
    joined = rows.withColumn("node", F.when(F.col("size") > 0, F.col("node"))).join(named, "node", "left")
    joined = joined.withColumn("component_id", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("_id")))
    return joined.select(F.col("_id").alias(doc_id), F.col("size").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), *carry)


def first_of_each(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, of several the first by place; rows without a class stay."""
    rows = rows.select("id", *PLACE, "node").join(classes, "node")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *PLACE)).alias("k"))
    return without(docs, rows.join(best.select("k." + PLACE[0], "k." + PLACE[1]), PLACE, "left_anti"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, and every row without shingles."""
    docs = located(docs)
    rows, nodes = sketched(docs, text, shingle, F.col(doc_id).alias("id"))
    return first_of_each(docs, rows.where("size > 0"), stage(linked_sets(nodes, docs, text, shingle, similarity)))
