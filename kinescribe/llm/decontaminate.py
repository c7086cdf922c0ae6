"""Benchmark decontamination by winnowing.

Words are hashed (a polynomial over their bytes, computed for a whole slice of texts at once), ``GRAM``
consecutive words form a gram, and of the grams of every ``SPAN`` consecutive words the smallest hash is kept (the last
one of equals). Two texts that share a window of ``SPAN`` words share all grams in it and so at least one kept
gram: each shared window is found. Texts and benchmark items are winnowed alike, joined on the hash, and
every hit is extended word by word to both sides, as far as one window reaches; what then covers ``SPAN``
equal words is a shared span. The words themselves are compared, so equal hashes of different words do no harm.

Before the join, a text keeps only the hashes that are in a Bloom bitmap of the benchmark's hashes; the bitmap
has a fixed size (``BITMAP_BITS``), which bounds what is broadcast. Equal stretches of a benchmark are one row
("passage") with a list of its items beside it, so a passage that many items share meets the texts once.

Items of fewer than ``SPAN`` words, but at least one, are one window each: for their lengths (at most
``SPAN`` - 1 of them), all runs of so many words are compared in the same way.

Edge cases: a null or wordless text has no words and no hits, such an item no window. Rows are told apart by
their place, so repeated rows and rows without an id get results of their own. Several items with the same id
count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.llm.common import PLACE, lazily, located, small_batches, stage, with_place, with_row, without
from kinescribe.llm.word_hashes import Slice, slices

#: Words of a window: what counts as shared.
SPAN = 10
GRAM = 5
BITMAP_BITS = 1 << 24


def _among(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in the bitmap (bytes, lowest bit first)."""
    bit = (hashes >> np.uint64(7)) & np.uint64(BITMAP_BITS - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


_HIT = pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("place", pa.int64()), ("before", pa.list_(pa.string())), ("gram", pa.string()), ("after", pa.list_(pa.string()))])
_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(_HIT))])
_FOUND_SQL = "n_words long, hits array<struct<size: int, hash: long, place: long, before: array<string>, gram: string, after: array<string>>>"


def _hit(piece: Slice, a: int, b: int, label: int, at: int, h: np.uint64) -> dict:
    """The run of ``abs(label)`` words at word ``at`` of the text with words a to b - 1.

    A winnowed gram has the words around it that one window can reach; ``before`` runs backwards. A short window has none.
    """
    end = at + abs(label)
    around = SPAN - label if label > 0 else 0

    def words(i: int, j: int) -> list[str]:
        return piece.text(i, j).split(" ") if i < j else []

    return {
        "size": label, "hash": int(h.astype(np.int64)), "place": at - a,
        "before": words(max(a, at - around), at)[::-1], "gram": piece.text(at, end), "after": words(end, min(b, end + around)),
    }


def _scan(texts: Iterable[str | None], size: int, kept, short) -> pa.Array:
    """Words and hits of each text; ``kept`` tells which hashes are of interest, ``short`` has the lengths of short windows."""
    out = [{"n_words": 0, "hits": []} for _ in range(size)]
    for first, piece in slices(texts):
        edges = piece.words.tolist()
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            out[first + i]["n_words"] = b - a
        for length in (None, *short):
            places, hashes = piece.kept(GRAM, SPAN) if length is None else piece.runs(length)
            good = kept(hashes)
            places, hashes = places[good], hashes[good]
            # A short window may have GRAM words too; a negative size marks it.
            label = GRAM if length is None else -length
            for i, at, h in zip((np.searchsorted(piece.words, places, "right") - 1).tolist(), places.tolist(), hashes):
                out[first + i]["hits"].append(_hit(piece, edges[i], edges[i + 1], label, at, h))
    return pa.array(out, _FOUND)


def _item_windows(texts: pa.Array) -> pa.Array:
    """All winnowed grams of a benchmark item; for a short item, its one window."""
    out = []
    for text in texts.to_pylist():
        piece = Slice([(text or "").encode("utf-8", "surrogatepass")])
        n = len(piece.hash)
        short = (n,) if 0 < n < SPAN else ()
        out += _scan([text], 1, lambda h: np.ones(len(h), bool), short).to_pylist()
    return pa.array(out, _FOUND)


def _bitmap(passages: DataFrame) -> np.ndarray:
    """Bitmap of the hashes: at most BITMAP_BITS / 64 rows reach the driver, whatever the size of the benchmark."""
    bit = F.shiftrightunsigned(F.col("hash"), 7).bitwiseAND(F.lit(BITMAP_BITS - 1))
    cells = passages.select(F.shiftright(bit, 6).cast("int").alias("cell"), (bit % 64).cast("int").alias("b"))
    words = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toPandas()
    found = np.zeros(BITMAP_BITS // 64, np.uint64)
    found[words["cell"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return found.view(np.uint8)


def _common(a: str, b: str, n: int):
    """How many words at the start of two arrays are equal, up to n."""
    out = F.lit(n)
    for k in range(n - 1, -1, -1):
        x, y = F.get(a, F.lit(k)), F.get(b, F.lit(k))
        out = F.when(F.coalesce(x == y, F.lit(False)), out).otherwise(k)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, the columns ``carry``, ``n_words``, ``spans`` (disjoint ranges of hit words: start, end), ``n_hit`` and ``item_ids`` (strings, sorted)."""
    spark = docs.sparkSession
    small_batches(spark)
    items = stage(with_row(benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")), "item_row"))
    hits = items.select("item", "item_row", F.inline(F.arrow_udf(_item_windows, _FOUND_SQL)("text")["hits"]))
    passages = hits.groupBy("size", "hash", "before", "gram", "after").agg(F.min(F.struct("item_row", "place")).alias("passage"))
    passages = stage(passages)
    of_items = hits.join(passages, ["size", "hash", "before", "gram", "after"]).select("passage", "item").distinct()

    shared = spark.sparkContext.broadcast(_bitmap(passages))
    short = [-r.size for r in passages.where("size < 0").select("size").distinct().collect()]

    @F.arrow_udf(_FOUND_SQL)
    def scanned(texts: pa.Array) -> pa.Array:
        known = shared.value
        return _scan(lazily(texts), len(texts), lambda h: _among(h, known), sorted(short))

    rows = with_row(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *carry))
    rows = stage(rows.select("_row", "doc_id", *carry, scanned("text").alias("f")).select("_row", "doc_id", *carry, "f.*"))

    d = rows.where(F.size("hits") > 0).select("_row", F.inline("hits")).alias("d")
    p = passages.alias("p")
    met = d.join(p, ["size", "hash"]).where("d.gram = p.gram")
    n = SPAN - GRAM
    met = met.withColumns({"left": F.when(F.col("size") < 0, 0).otherwise(_common("d.before", "p.before", n)), "right": F.when(F.col("size") < 0, 0).otherwise(_common("d.after", "p.after", n))})
    met = met.where((F.col("size") < 0) | (F.col("left") + F.col("right") >= n))
    met = met.select("_row", "p.passage", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.abs("size") + F.col("right")).alias("end"))
    met = stage(met)

    order = Window.partitionBy("_row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = met.select("_row", "start", "end").distinct().withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    spans = opens.withColumn("span", F.sum("opens").over(order)).groupBy("_row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    ids = met.select("_row", "passage").distinct().join(of_items, "passage").groupBy("_row").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("item_ids"))
    out = rows.select("_row", "doc_id", *carry, "n_words").join(spans, "_row", "left").join(ids, "_row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(
        F.col("doc_id").alias(doc_id), *carry, "n_words", F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"),
        F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that share a window with a benchmark item."""
    docs = located(docs)
    found = find_contamination(with_place(docs), benchmark, doc_id, text, item_id, item_text, PLACE)
    return without(docs, found.where("n_hit > 0"))
